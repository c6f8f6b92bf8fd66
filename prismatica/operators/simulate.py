"""Simulation: fix one feature to each partition's value, predict, and aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_quantile
from .models import Model, as_model
from .partition import CategoryPartitioner, Partitioner, Partitioning
from .sample import Sample


@dataclass
class SimulationResult:
    """``frame``: partition_idx, partition, mean, sem, lower_bound, upper_bound, frequency."""

    frame: DataFrame = field(repr=False)
    feature_name: str
    output_name: str
    output_unit: str
    baseline: float | None
    confidence_level: float
    partitioning: Partitioning = field(repr=False)


class UnivariateSimulator:
    output_unit = "Mean predicted target"

    def __init__(self, model, sample: Sample, *, confidence_level: float = 0.95):
        self.model: Model = as_model(model, sample.feature_names)
        if len(sample.target_names) > 1:
            raise NotImplementedError("a simulation takes a sample of one target")
        if not 0 < confidence_level < 1:
            raise ValueError(f"a confidence level lies between 0 and 1: {confidence_level}")
        self.sample, self.confidence_level = sample, confidence_level
        self.check()

    def check(self) -> None:
        if len(self.model.output_names) != 1:
            raise NotImplementedError("a simulation takes a model of one output")

    @property
    def output_name(self) -> str:
        return self.sample.target_names[0]

    def expected_output(self) -> Column:
        """Aggregate of the observed target."""
        return F.avg(F.col(self.sample.target_names[0]).cast("double"))

    def simulate_feature(self, feature_name: str, partitioner: Partitioner, **bounds) -> SimulationResult:
        """Weights don't count in simulations; every row stands in for each value once."""
        if feature_name not in self.sample.feature_names:
            raise ValueError(f"unknown feature: {feature_name}")
        partitions = partitioner.fit(self.sample.frame, feature_name, **bounds)
        return self._result(feature_name, partitions)

    def _statistics(self, feature_name: str, partitions: Partitioning) -> DataFrame:
        frame = self.sample.frame.select(*self.sample.feature_names)
        kind = frame.schema[feature_name].dataType
        # a value takes the type of the feature it replaces; the list has max_partitions entries
        values = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(v).cast(kind).alias("value")) for i, v in enumerate(partitions.values)])
        fixed = frame.drop(feature_name).select("*", F.explode(values).alias("__at")).select(
            *[F.col("__at.value").alias(f) if f == feature_name else F.col(f) for f in self.sample.feature_names], F.col("__at.idx").alias("partition_idx")
        )
        return (
            self.model.predict(fixed, ["__prediction"])
            .groupBy("partition_idx")
            .agg(F.avg("__prediction").alias("mean"), (F.try_divide(F.stddev_samp("__prediction"), F.sqrt(F.count("__prediction").cast("double")))).alias("sem"))
        )

    def _result(self, feature_name: str, partitions: Partitioning) -> SimulationResult:
        z = -normal_quantile((1 - self.confidence_level) / 2)
        frame = (
            partitions.frame()
            .join(F.broadcast(self._statistics(feature_name, partitions)), "partition_idx")
            .select("partition_idx", "partition", "mean", "sem", (F.col("mean") - z * F.col("sem")).alias("lower_bound"), (F.col("mean") + z * F.col("sem")).alias("upper_bound"), "frequency")
        )
        return SimulationResult(frame, feature_name, self.output_name, self.output_unit, None, self.confidence_level, partitions)


class UnivariateTargetSimulator(UnivariateSimulator):
    """Mean predicted target."""

    def _result(self, feature_name, partitions):
        result = super()._result(feature_name, partitions)
        result.baseline = self.sample.frame.agg(self.expected_output()).first()[0]
        result.output_unit = f"Mean predicted target ({self.output_name})"
        return result


class UnivariateUpliftSimulator(UnivariateSimulator):
    """Mean predicted target less the observed mean."""

    def _result(self, feature_name, partitions):
        result = super()._result(feature_name, partitions)
        base = self.sample.frame.agg(self.expected_output().alias("__base"))
        result.frame = result.frame.join(F.broadcast(base)).select(
            "partition_idx", "partition", *[(F.col(c) - F.col("__base")).alias(c) if c != "sem" else F.col(c) for c in ("mean", "sem", "lower_bound", "upper_bound")], "frequency"
        )
        result.baseline, result.output_unit = 0.0, f"Mean predicted uplift ({self.output_name})"
        return result


class UnivariateProbabilitySimulator(UnivariateSimulator):
    """Mean predicted probability of the positive class of a binary classifier."""

    def __init__(self, model, sample, *, confidence_level: float = 0.95, positive_class=1):
        self.positive_class = positive_class
        super().__init__(model, sample, confidence_level=confidence_level)

    def check(self):
        if self.model.kind not in ("classifier", "function") or getattr(self.model, "n_classes", 2) != 2:
            raise TypeError("probabilities need a classifier of two classes")
        super().check()

    def expected_output(self):
        return F.avg((F.col(self.sample.target_names[0]) == F.lit(self.positive_class)).cast("double"))

    def _result(self, feature_name, partitions):
        result = super()._result(feature_name, partitions)
        result.baseline = self.sample.frame.agg(self.expected_output()).first()[0]
        result.output_name = result.output_unit = f"probability({self.positive_class})"
        return result


__all__ = ["CategoryPartitioner", "SimulationResult", "UnivariateProbabilitySimulator", "UnivariateSimulator", "UnivariateTargetSimulator", "UnivariateUpliftSimulator"]
