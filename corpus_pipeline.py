"""A training corpus from documents: five stages, each one operator, each written before the next."""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prismatica.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from prismatica.llm.common import forget, shared_folder, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the classifier; null and empty texts go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: that of the least id; rows without an id only if no equal text has one."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of similar texts: that of the least id."""
    return near_dedup.drop_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows as often as the mix takes them, and leaves out those that it doesn't; null is a source of its own."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document of the mix, and the bytes they decode to; repeated rows stay repeated.

    All stages take an empty table, and keep columns beside those of ``documents``.
    """
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as file:
        return byte_bpe.encode_documents(docs, file.read(), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: The classifier, the signatures and the tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again.

    The tables between stages are deleted when the driver's program ends.
    """
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    forget(spark, folder)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := posixpath.join(folder, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
