"""Bootstraps as index tables, drawn by hashing so that any engine repeats them.

``(split, slot, pos)``: slot ``slot`` of split ``split`` holds the row at
position ``pos``. Nothing is materialised on the driver. A split that draws
every row has nothing to test on and is drawn again.
"""

from __future__ import annotations

import math
import warnings
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.scalars import hash_draw, hash_uniform

CHUNK = 4096
#: Chance that any split draws every row, below which that isn't looked for.
NEGLIGIBLE = 1e-12


class Bootstrap(ABC):
    def __init__(self, n_splits: int = 1000, random_state: int = 0):
        if n_splits < 1:
            raise ValueError(f"one split is the least, not {n_splits}")
        self.n_splits, self.seed = n_splits, random_state

    def get_n_splits(self) -> int:
        return self.n_splits

    def slots(self, spark: SparkSession, n: int, splits: Sequence[int]) -> DataFrame:
        """``(split, slot)`` of the splits; a run of splits is computed from a range of numbers."""
        if n < 2:
            raise ValueError("resampling needs two rows at least")
        first, last = min(splits), max(splits)
        every = spark.range(first * n, (last + 1) * n).select(F.floor(F.col("id") / n).cast("int").alias("split"), F.pmod("id", F.lit(n)).cast("long").alias("slot"))
        return every if len(splits) == last - first + 1 else every.filter(F.col("split").isin(list(splits)))

    def index(self, df: DataFrame, order: list[str], splits: Sequence[int] | None = None, groups=None) -> DataFrame:
        """Positions drawn for each split (or those asked for), in terms of the given order."""
        if groups is not None:
            warnings.warn(f"bootstraps have no groups; left out: {groups!r}", stacklevel=2)
        wanted = list(range(self.n_splits)) if splits is None else list(splits)
        n = df.count()
        sizes = self.sizes(df, order)
        chance, parts, again = self.log_chance(sizes, n), [], 0
        while wanted:
            drawn = self.draw(df.sparkSession, sizes, n, wanted, str(self.seed) if not again else f"{self.seed}~{again}")
            whole = []
            if math.exp(min(chance, 0)) * len(wanted) > NEGLIGIBLE:
                # at most one number a split
                whole = [r["split"] for r in drawn.groupBy("split").agg(F.count_distinct("pos").alias("n")).filter(F.col("n") == n).collect()]
            parts.append(drawn.filter(~F.col("split").isin(whole)) if whole else drawn)
            wanted, again = whole, again + 1
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def placed(self, df: DataFrame, order: list[str]) -> DataFrame:
        """The rows with the positions that draws are made of."""
        return numbered(df, order)

    def sizes(self, df: DataFrame, order: list[str]) -> DataFrame | None:
        """``(n, start)`` of the groups of positions that are drawn from apart; None for one group of all."""
        return None

    def log_chance(self, sizes: DataFrame | None, n: int) -> float:
        """Logarithm of a bound on the chance that a split draws every row: n! / n ** n by Stirling."""
        return -n + math.log(2 * math.pi * max(n, 1)) / 2 + 1 / (12 * max(n, 1))

    @abstractmethod
    def draw(self, spark: SparkSession, sizes: DataFrame | None, n: int, splits: Sequence[int], seed: str) -> DataFrame: ...

    def train(self, df: DataFrame, order: list[str], splits: Sequence[int] | None = None) -> DataFrame:
        """Rows of each split, repeats kept."""
        return self.index(df, order, splits).join(self.placed(df, order), "pos").drop("pos", "__stratum")

    def test(self, df: DataFrame, order: list[str], splits: Sequence[int] | None = None) -> DataFrame:
        """``(split, rows)`` that a split didn't draw."""
        placed = self.placed(df, order)
        wanted = range(self.n_splits) if splits is None else splits
        every = placed.select("pos", F.explode(F.array(*[F.lit(k) for k in wanted])).alias("split"))
        left = every.join(self.index(df, order, splits).select("split", "pos").distinct(), ["split", "pos"], "left_anti")
        return left.join(placed, "pos").drop("pos", "__stratum")


class BootstrapCV(Bootstrap):
    """Draws all rows with replacement."""

    def draw(self, spark, sizes, n, splits, seed):
        return self.slots(spark, n, splits).withColumn("pos", hash_draw(n, seed, F.col("split"), F.col("slot")))


class StratifiedBootstrapCV(Bootstrap):
    """Draws from each stratum as many rows as it has; positions run through the strata in the order of their values."""

    def __init__(self, n_splits: int = 1000, random_state: int = 0, *, stratum: str | None = None):
        super().__init__(n_splits, random_state)
        if stratum is None:
            raise ValueError("name the column that holds the strata")
        self.stratum = stratum

    def sizes(self, df, order):
        # one row a stratum
        found = df.groupBy(F.col(self.stratum).alias("__stratum")).agg(F.count(F.lit(1)).alias("n"))
        ahead = F.sum("n").over(Window.orderBy("__stratum").rowsBetween(Window.unboundedPreceding, -1))
        return found.select("n", F.coalesce(ahead, F.lit(0)).alias("start"))

    def log_chance(self, sizes, n):
        size = F.col("n")
        all_drawn = -size + F.log(2 * math.pi * size) / 2 + 1 / (12 * size)
        found = sizes.agg(F.max("n").alias("most"), F.sum(all_drawn).alias("chance")).first()
        if found["most"] in (None, 1):
            raise ValueError("every stratum has one row: no split could leave one out")
        return found["chance"]

    def draw(self, spark, sizes, n, splits, seed):
        # chunks of slots first, dealt out, so that no row holds a whole stratum
        chunks = (
            sizes.withColumn("split", F.explode(F.array(*[F.lit(k) for k in splits])))
            .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
            .repartition("split", "start", "__chunk")
        )
        inside = F.sequence(F.col("__chunk") * CHUNK, F.least(F.col("n"), (F.col("__chunk") + 1) * CHUNK) - 1)
        return (
            chunks.withColumn("__i", F.explode(inside))
            .withColumn("slot", F.col("start") + F.col("__i"))
            .select("split", "slot", (F.col("start") + hash_draw(F.col("n"), seed, F.col("split"), F.col("slot"))).alias("pos"))
        )

    def placed(self, df: DataFrame, order: list[str]) -> DataFrame:
        stratum = F.col(self.stratum)
        sizes = df.groupBy(stratum.alias("__stratum")).agg(F.count(F.lit(1)).alias("__n"))
        # one row a stratum
        ahead = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ids = numbered(df.withColumn("__stratum", stratum), order, "__pos")
        # a row's place in its stratum, by blocks of positions so that no task orders a whole stratum
        ids = ids.withColumn("__block", F.floor(F.col("__pos") / CHUNK))
        counts = ids.groupBy("__stratum", "__block").agg(F.count(F.lit(1)).alias("__c"))
        counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy("__stratum").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
        inside = F.row_number().over(Window.partitionBy("__stratum", "__block").orderBy("__pos")) - 1
        return (
            ids.join(counts, ["__stratum", "__block"])
            .withColumn("__in", F.col("__before") + inside)
            .join(F.broadcast(ahead), "__stratum")
            .withColumn("pos", (F.col("__start") + F.col("__in")).cast("long"))
            .drop("__pos", "__block", "__before", "__in", "__n", "__start")
        )


class StationaryBootstrapCV(Bootstrap):
    """Politis and Romano's stationary bootstrap: circular blocks of geometric length."""

    def __init__(self, n_splits: int = 1000, random_state: int = 0, *, mean_block_size: int | float = 0.1):
        super().__init__(n_splits, random_state)
        if isinstance(mean_block_size, bool) or not isinstance(mean_block_size, (int, float)):
            raise TypeError("a block size is a whole number of rows or a share of them")
        if isinstance(mean_block_size, int) and mean_block_size < 2:
            raise ValueError("blocks have two rows on average at least")
        if isinstance(mean_block_size, float) and not 0 < mean_block_size < 1:
            raise ValueError("a share of rows lies between 0 and 1")
        self.mean_block_size = mean_block_size

    def _size(self, n: int) -> float:
        return self.mean_block_size if isinstance(self.mean_block_size, int) else max(1.0, n * self.mean_block_size)

    def log_chance(self, sizes, n):
        # n rows are all different only if their blocks fit together: each start beyond the first has one place
        return (n - 1) * math.log(max(1 / self._size(n), 1 - 1 / self._size(n))) + math.log(max(n, 1))

    def draw(self, spark, sizes, n, splits, seed):
        size = self._size(n)
        slots = self.slots(spark, n, splits)
        starts = (F.col("slot") == 0) | (hash_uniform(seed, "block", F.col("split"), F.col("slot")) < 1.0 / size)
        slots = slots.withColumn("__start", F.when(starts, F.col("slot"))).withColumn("__chunk", F.floor(F.col("slot") / CHUNK))
        # last start at or before a slot: inside its chunk, else the last of earlier chunks
        chunks = slots.groupBy("split", "__chunk").agg(F.max("__start").alias("__last"))
        chunks = chunks.withColumn("__earlier", F.max("__last").over(Window.partitionBy("split").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
        here = F.max("__start").over(Window.partitionBy("split", "__chunk").orderBy("slot"))
        return (
            slots.withColumn("__here", here)
            .join(chunks, ["split", "__chunk"])
            .withColumn("__from", F.coalesce("__here", "__earlier"))
            .select("split", "slot", F.pmod(hash_draw(n, seed, F.col("split"), F.col("__from")) + F.col("slot") - F.col("__from"), F.lit(n)).cast("long").alias("pos"))
        )
