"""Reading samples from files: delimited text, Parquet and whatever Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sample import Sample


def read_table(spark: SparkSession, path: str, *, format: str | None = None, schema: str | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """CSV (also tab- or semicolon-delimited), Parquet, ORC or JSON by the file's ending or ``format``.

    Pass a schema for large CSV files: without one, types are inferred by an extra pass.
    """
    kind = format or {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "orc": "orc", "json": "json"}.get(path.rsplit(".", 1)[-1].lower(), "parquet")
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("sep", "\t" if path.endswith(".tsv") and delimiter == "," else delimiter).option("header", header)
        if not schema:
            reader = reader.option("inferSchema", True)
    return reader.format(kind).load(path)


def read_sample(spark: SparkSession, path: str, *, target_name, feature_names=None, weight_name=None, id_name=None, **options) -> Sample:
    return Sample(read_table(spark, path, **options), target_name=target_name, feature_names=feature_names, weight_name=weight_name, id_name=id_name)


def write_sample(sample: Sample, path: str, format: str = "parquet", mode: str = "error") -> None:
    sample.frame.write.format(format).mode(mode).save(path)
