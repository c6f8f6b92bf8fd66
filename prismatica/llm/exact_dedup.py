"""Exact deduplication by skew-safe combining (DataFrame functions only).

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]``
became one space. Three stages, each comparing full content:

1. local: rows are grouped by (digest, salt, content); Spark's partial
   aggregation removes the copies inside each input partition first,
2. salted: copies of one digest meet in ``salts`` separate groups,
3. global: the at most ``salts`` winners of a digest meet, content is compared
   once more, and the overall winner goes back to every (digest, salt).

So no task ever holds more of one group than its local winners. Rows then find
their winner by (digest, salt), which also splits a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, columns, filled, row_key, shuffle_width, unused

#: Salts of a digest at least; as many as there are shuffle partitions if those are more.
SALTS = 16


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id, group_size, kept, text_sha256``.

    Null and empty texts are equal. The smallest id of a group stays; a null id
    stays only if all ids of its group are null. Rows that repeat the kept id
    count in ``group_size`` and are marked alike (``drop_copies`` keeps one).
    Texts of any length are compared whole, an empty table gives no rows, and
    columns other than the two named are ignored. Two contents of one SHA-256
    would raise an error.
    """
    return _groups(docs, id_column, text_column, salts).drop("__key")


def _groups(docs: DataFrame, id_column: str, text_column: str, salts: int | None) -> DataFrame:
    salts = salts or max(SALTS, shuffle_width(docs.sparkSession))
    ident = F.col(id_column)
    content = F.regexp_replace(filled(text_column), f"[{SPACE}]+", " ")
    # rows without an id are dealt by their own key
    salt = F.pmod(F.xxhash64(ident, F.when(ident.isNull(), row_key(id_column, text_column))), F.lit(salts))
    rows = docs.select(
        ident.alias("__id"), row_key(id_column, text_column).alias("__key"), salt.alias("__salt"), content.alias("__content")
    ).withColumn("__digest", F.sha2("__content", 256))

    salted = rows.groupBy("__digest", "__salt", "__content").agg(F.min("__id").alias("__least"), F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy("__digest")
    winners = salted.select(
        "__digest",
        "__salt",
        F.min("__least").over(group).alias("keep_id"),
        F.sum("__n").over(group).alias("group_size"),
        (F.min("__content").over(group) == F.max("__content").over(group)).alias("__same"),
    ).select(
        "__digest",
        "__salt",
        "keep_id",
        F.when(F.col("__same"), F.col("group_size")).otherwise(F.raise_error(F.lit("two contents share a SHA-256")).cast("long")).alias("group_size"),
    )
    return (
        rows.drop("__content")
        .join(winners, ["__digest", "__salt"])
        .select(
            F.col("__id").alias(id_column),
            "keep_id",
            "group_size",
            F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("__digest").alias("text_sha256"),
            "__key",
        )
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int | None = None) -> DataFrame:
    """One row of ``docs`` for each text, with all its columns: that of the smallest id; of repeated rows one."""
    key, again = unused(docs, "row_key"), unused(docs, "again")
    # rows of one id may differ in white space: the least key decides
    kept = _groups(docs, id_column, text_column, salts).filter("kept").groupBy("text_sha256").agg(F.min("__key").alias(key)).select(key)
    rows = docs.withColumn(key, row_key(id_column, text_column)).join(kept, key)
    return rows.withColumn(again, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(again) == 1).select(*columns(docs))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""
