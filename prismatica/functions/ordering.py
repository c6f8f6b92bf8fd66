"""Positions, running totals and exact quantiles without a single-task sort.

For positions, a column's approximate percentiles (one row) cut the rows into buckets of known
order; bucket totals are summed first, then each bucket is ordered by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets at least and at most; four a shuffle partition in between.
FEWEST, MOST = 256, 16384


def running_total(df: DataFrame, order: list[str], weight: Column | None = None, name: str = "before", buckets: int | None = None) -> DataFrame:
    """``df`` plus the total weight of all rows that sort before the row.

    ``order`` should be unique; its first column is a number, date or timestamp
    and must not be null. Rows of one value of that column share a bucket.
    """
    buckets = buckets or min(max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), FEWEST), MOST)
    fan, lead = round(buckets**0.5), F.col(order[0])
    as_number = F.unix_micros(lead.cast("timestamp")) if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else lead
    rows = df.withColumn("__lead", as_number).withColumn("__weight", weight if weight is not None else F.lit(1))
    cuts = rows.agg(F.percentile_approx("__lead", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("__cuts"))
    # the number of cuts below a value, in two steps: every fan-th cut, then those in between
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda c, i: i % fan == fan - 1))
    below = lambda cut: F.size(F.filter(cut, lambda c: c < F.col("__lead")))
    rows = rows.join(F.broadcast(cuts)).withColumn("__block", below(F.col("__coarse")) * fan).withColumn("__bucket", F.col("__block") + below(F.slice("__cuts", F.col("__block") + 1, F.lit(fan))))
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__bucket").agg(F.sum("__weight").alias("__total")).select("__bucket", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # at most ``buckets`` rows of totals: always small enough to broadcast
    return rows.join(F.broadcast(totals), "__bucket").withColumn(name, F.col("__ahead") + F.coalesce(F.sum("__weight").over(inside), F.lit(0))).drop("__bucket", "__lead", "__weight", "__cuts", "__coarse", "__block", "__ahead")


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` plus each row's position, from 0, in the given order."""
    return running_total(df, order, name=name).withColumn(name, F.col(name).cast("long"))


#: Values of a range that are few enough to be looked at on the driver.
FEW = 1 << 14
#: Half the share of values between two looks around a rank, ten times the sketch's error.
AROUND, ACCURACY = 1e-3, 10_000


@dataclass
class Bracket:
    """A rank, and what is known of its value: above ``low`` and below ``high``, ``n`` values between, ``below`` up to ``low``."""

    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    def inside(self) -> Column:
        test = F.lit(True)
        if self.low is not None:
            test = test & (F.col("v") > self.low)
        return test if self.high is None else test & (F.col("v") < self.high)

    def look(self) -> Column:
        """Two values around the rank, roughly."""
        at = (self.rank - self.below + 0.5) / self.n
        return F.percentile_approx(F.when(self.inside(), F.col("v")), [max(at - AROUND, 0.0), min(at + AROUND, 1.0)], ACCURACY)

    def narrow(self, a: float, b: float, before: int, at_a: int, between: int, at_b: int) -> None:
        """Take over the counts of values before, at and between ``a`` and ``b``."""
        after = self.n - before - at_a - between - at_b
        parts = [(before, self.low, a, None), (at_a, a, a, a), (between, a, b, None), (at_b, b, b, b), (after, b, self.high, None)]
        for count, low, high, value in parts:
            if self.rank < self.below + count:
                self.n, self.low, self.high, self.value = count, low, high, value
                return
            self.below += count


def order_statistics(values: DataFrame, ranks: list[int], total: int) -> dict[int, float]:
    """The values of ``v`` at ranks from 0: scans that count around two guesses, no shuffle or sort of the column."""
    brackets = [Bracket(r, total) for r in ranks]
    while many := [b for b in brackets if b.value is None and b.n > FEW]:
        looks = values.agg(*[b.look().alias(f"l{i}") for i, b in enumerate(many)]).first()
        counts = []
        for b, (x, y) in zip(many, looks):
            v, inside = F.col("v"), b.inside()
            counts += [F.count_if(inside & (v < x)), F.count_if(v == x), F.count_if((v > x) & (v < y)), F.count_if(v == y) if y > x else F.lit(0)]
        found = values.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
        for i, (b, (x, y)) in enumerate(zip(many, looks)):
            b.narrow(x, y, *found[4 * i : 4 * i + 4])
    for b in brackets:
        if b.value is None:
            # at most FEW values
            b.value = sorted(r["v"] for r in values.filter(b.inside()).collect())[b.rank - b.below]
    return {b.rank: b.value for b in brackets}


def quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float] | None:
    """Exact quantiles with linear interpolation of the values that are neither null nor NaN; None if there are none."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    total = values.count()
    if not total:
        return None
    wanted = [(total - 1) * p for p in probabilities]
    at = order_statistics(values, sorted({int(w) for w in wanted} | {min(int(w) + 1, total - 1) for w in wanted}), total)
    return [at[int(w)] + (at[min(int(w) + 1, total - 1)] - at[int(w)]) * (w - int(w)) for w in wanted]
