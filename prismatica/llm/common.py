"""Shared pieces: reading tables, cutting lineage in the shared folder, row keys."""

from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one (tests) gets its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="checkpoints-")
        folder = _OWN[context.applicationId]
    return folder


_OWN: dict[str, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it again: lost executors lose nothing.

    The table is deleted when the driver's program ends.
    """
    path = posixpath.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    forget(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage when the driver's program ends."""
    atexit.register(_forget, spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session may have been stopped before
        with suppress(Py4JError, OSError):  # or its JVM
            delete(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """The name, made different from all columns."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever marks their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


class Scratch:
    """Tables in the shared folder that last as long as one operator runs.

    A checkpoint keeps the size estimated for its plan, and estimates multiply
    at joins: in a loop of joins and checkpoints they grow to numbers of millions
    of digits, which fill the driver. A table that is read again has its true size.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.tables = spark, 0
        self.folder = posixpath.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the rows out and read them again."""
        self.tables += 1
        df.write.parquet(path := posixpath.join(self.folder, str(self.tables)))
        return self.spark.read.schema(df.schema).parquet(path)


def filled(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A 64-bit hash of id and text: what identifies a row inside an operator.

    Rows that repeat both share it, and get equal results.
    """
    return F.xxhash64(F.col(id_column).cast("long"), filled(text_column))


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, key, text)`` with the row key; ids may be null or repeated."""
    return docs.select(F.col(id_column).cast("long").alias("id"), row_key(id_column, text_column).alias("key"), filled(text_column).alias("text"))
