"""Keeping histogram and simulation tables up to date on a stream of observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models import Model
from ..operators.partition import Partitioning


def windowed_histogram(events: DataFrame, time_column: str, partitioning: Partitioning, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Partition counts per time window of a streaming (or batch) frame, with late rows up to ``delay``."""
    timed = events.withWatermark(time_column, delay) if events.isStreaming else events
    return (
        timed.withColumn("partition_idx", partitioning.index)
        .filter(F.col("partition_idx").between(0, len(partitioning.values) - 1))
        .groupBy(F.window(time_column, window).alias("window"), "partition_idx")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def simulate_each_batch(stream: DataFrame, simulate: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a simulation on every micro-batch and hand its result to ``sink`` with the batch number."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(simulate(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def predict_stream(stream: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """Predictions of a streaming frame."""
    return model.predict(stream, names)
