"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

A source's target is ``min(cap, level * weight)``: the water level at which all
targets sum to the size of the mix, with each source clamped at its maximum
epochs. Sorted by cap / weight, the level is found from prefix sums, which is
the fixed point of clamping and resharing the excess by weight.

Inside a source every document is taken ``whole`` times and a seeded sample of
documents once more. The sample is a prefix of the documents in hash order that
sums to the fractional part: hash buckets are summed first, so the prefix needs
an order only inside buckets and no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, row_key, stored, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
#: Hex digits of the hash that name a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    Weights repeat over the sources by code point, null last. One row a source
    meets in one task here, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select(
        "source", "source_size", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).alias("weight")
    ).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("mix", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("mix") - F.col("cap_before")) / (F.sum("weight").over(everything) - F.col("weight_before")))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
        # the level of the first source that isn't clamped holds for all after it
        .withColumn("water", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    )
    return filled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: id, ``size, source_size, target, taken``.

    ``size`` counts words (null and empty texts: 0); null is a source of its
    own, last. A document's repetitions are ``taken / size``: the whole part of
    target / source_size for all, and one more for a seeded sample of documents
    that ends nearest to the target. A source without words has target 0 and
    documents without words take nothing. Repeated rows are separate documents,
    in an order among themselves that doesn't change the rows returned. An empty
    table gives no rows; other columns are ignored.
    """
    return _plan(docs, id_column, text_column, source_column, weights, share, max_epochs, seed).drop("__key")


def _plan(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights, share, max_epochs, seed: int) -> DataFrame:
    """The mix, with a key of each row's id, text and source."""
    key = F.xxhash64(row_key(id_column, text_column), F.col(source_column))
    # rows without an id are dealt by their key
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("-:"), key.cast("string")))))
    sized = stored(docs.select(F.col(id_column).alias("__id"), F.col(source_column).alias("source"), word_count(text_column).alias("size"), code.alias("__code"), key.alias("__key")), "mix")
    sized = sized.withColumn("__bucket", F.substring("__code", 1, BUCKET_DIGITS))

    buckets = sized.groupBy("source", "__bucket").agg(F.sum("size").alias("bucket_size"))
    goals = (
        targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    running = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).drop("bucket_size")
    # null sources join too: both sides carry the name or a stand-in with a flag
    joinable = lambda df: df.select("*", F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__source")).drop("source")
    plan = joinable(plan).join(joinable(goals), ["__none", "__source"])
    inside = Window.partitionBy("__none", "__source", "__bucket").orderBy("__code", "__id", "size", "__key").rowsBetween(Window.unboundedPreceding, 0)
    return (
        joinable(sized)
        .join(plan, ["__none", "__source", "__bucket"])
        # a document is in the sample if its middle lies before the goal
        .withColumn("extra", (2 * (F.col("before") + F.sum("size").over(inside)) - F.col("size") <= 2 * F.col("goal")).cast("long"))
        .withColumn("extra", F.when(F.col("goal") > 0, F.col("extra")).otherwise(F.lit(0)))
        .select(
            F.col("__id").alias(id_column),
            "size",
            "source_size",
            "target",
            (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"),
            (F.col("whole") + F.col("extra")).alias("repeats"),
            "__key",
        )
    )


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, all columns kept.

    Rows that repeat id, text and source share what is taken of them all.
    """
    key, taken, rows, again = (unused(docs, name) for name in ("row_key", "taken", "rows", "again"))
    plan = _plan(docs, id_column, text_column, source_column, weights, share, max_epochs, seed)
    plan = plan.groupBy(F.col("__key").alias(key)).agg(F.sum("repeats").alias(taken), F.count(F.lit(1)).alias(rows)).filter(F.col(taken) > 0)
    found = docs.withColumn(key, F.xxhash64(row_key(id_column, text_column), F.col(source_column))).join(plan, key)
    # the first of equal rows take what is left over
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    found = found.withColumn(again, place).withColumn(again, F.floor(F.col(taken) / F.col(rows)) + (F.col(again) <= F.pmod(taken, rows)).cast("long"))
    return found.filter(F.col(again) > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(again)))).select(*columns(docs))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('42:' || doc_id::VARCHAR) AS code
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
p AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before,
        (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS mix, sum(weight) OVER () AS all_weight
      FROM r WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (mix - cap_before) / (all_weight - weight_before) AS level FROM p),
w AS (SELECT arg_min(level, cap / weight) AS water FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT water FROM w) * weight, cap))::DOUBLE AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS goal,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.code, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN goal > 0 AND 2 * upto - size <= 2 * goal THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN goal > 0 AND 2 * upto - size <= 2 * goal THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM c
"""
