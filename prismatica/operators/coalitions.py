"""Shapley attribution as one aggregate of coalition values and a constant linear map.

The value of a coalition S at x is the mean of f over the background, with the
features in S from x and the others from the background. Exact, kernel and
permutation attributions are all linear in these values, so each is a table of
coefficients computed once on the driver from the number of features.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from math import comb, factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import ColumnModel, Model, PandasModel

MAX_BACKGROUND = 1000
MAX_EXACT = 12
#: Rows that a vectorised model scores at once.
HYBRID_ROWS = 1 << 16


@dataclass
class ShapFrame:
    """One row per observation and output: id, ``output``, ``weight``, ``phi_i`` and, with interactions, ``int_i_j`` for i <= j."""

    frame: DataFrame = field(repr=False)
    id_name: str
    feature_names: list[str]
    output_names: list[str]
    interactions: bool

    def values(self) -> DataFrame:
        """``(id, output, feature, phi)``."""
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"phi_{i}").alias("phi")) for i, f in enumerate(self.feature_names)]))
        return self.frame.select(self.id_name, "output", cells.alias("c")).select(self.id_name, "output", "c.feature", "c.phi")

    def _need(self) -> None:
        if not self.interactions:
            raise RuntimeError("no interactions here: explain with interactions=True")

    def interaction_values(self) -> DataFrame:
        """``(id, output, feature_i, feature_j, phi)`` for all ordered pairs."""
        self._need()
        m = len(self.feature_names)
        cells = [
            F.struct(F.lit(self.feature_names[i]).alias("feature_i"), F.lit(self.feature_names[j]).alias("feature_j"), F.col(f"int_{min(i, j)}_{max(i, j)}").alias("phi"))
            for i in range(m)
            for j in range(m)
        ]
        return self.frame.select(self.id_name, "output", F.explode(F.array(*cells)).alias("c")).select(self.id_name, "output", "c.feature_i", "c.feature_j", "c.phi")

    def main_effects(self) -> DataFrame:
        return self.interaction_values().filter("feature_i = feature_j").select(self.id_name, "output", F.col("feature_i").alias("feature"), "phi")

    def output(self, name: str) -> DataFrame:
        return self.frame.filter(F.col("output") == name)


def members(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def exact_coefficients(m: int) -> tuple[list[int], np.ndarray]:
    """Coalitions, and the Shapley weight of each for each feature."""
    masks, out = list(range(2**m)), np.zeros((m, 2**m))
    for s in masks:
        size = s.bit_count()
        for i in range(m):
            if s >> i & 1:
                out[i, s] += factorial(size - 1) * factorial(m - size) / factorial(m)
            else:
                out[i, s] -= factorial(size) * factorial(m - size - 1) / factorial(m)
    return masks, out


def interaction_coefficients(m: int) -> np.ndarray:
    """Coefficients of the interaction matrix: half the Shapley interaction index off the diagonal, rows sum to the SHAP value."""
    _, single = exact_coefficients(m)
    out = np.zeros((m, m, 2**m))
    for i in range(m):
        for j in range(m):
            if i != j:
                for s in range(2**m):
                    rest = (s & ~(1 << i) & ~(1 << j)).bit_count()
                    weight = factorial(rest) * factorial(m - rest - 2) / factorial(m - 1) / 2
                    out[i, j, s] = weight if (s >> i & 1) == (s >> j & 1) else -weight
    for i in range(m):
        out[i, i] = single[i] - out[i].sum(axis=0)
    return out


def kernel_coefficients(m: int, n_samples: int = 2048, seed: int = 0) -> tuple[list[int], np.ndarray]:
    """Weighted least squares over coalitions, with the sum of attributions fixed.

    All coalitions if there are no more than ``n_samples``, else seeded pairs of
    a coalition and its complement, drawn by the kernel's weights.
    """
    full = 2**m - 1
    if m == 1:
        return [0, full], np.array([[-1.0, 1.0]])
    if 2**m - 2 <= n_samples:
        inner = list(range(1, full))
        weight = np.array([(m - 1) / (comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in inner])
    else:
        rng, drawn = random.Random(seed), {}
        sizes = list(range(1, m))
        for _ in range(n_samples // 2):
            k = rng.choices(sizes, [1 / (s * (m - s)) for s in sizes])[0]
            s = sum(1 << i for i in rng.sample(range(m), k))
            for mask in (s, full ^ s):
                drawn[mask] = drawn.get(mask, 0) + 1
        inner, weight = list(drawn), np.array(list(drawn.values()), float)
    z = np.array([[s >> i & 1 for i in range(m)] for s in inner], float)
    # eliminate the last feature: y = v(S) - v0 - z_last (v1 - v0)
    x = z[:, :-1] - z[:, -1:]
    solve = np.linalg.pinv((x * weight[:, None]).T @ x) @ (x * weight[:, None]).T
    masks = [0, full, *inner]
    y = np.zeros((len(inner), len(masks)))
    y[:, 0], y[:, 1] = z[:, -1] - 1, -z[:, -1]
    y[np.arange(len(inner)), 2 + np.arange(len(inner))] = 1
    head = solve @ y
    last = -head.sum(axis=0)
    last[1] += 1
    last[0] -= 1
    return masks, np.vstack([head, last])


def permutation_coefficients(m: int, n_permutations: int = 10, seed: int = 0) -> tuple[list[int], np.ndarray]:
    """Walks through seeded permutations, forwards and backwards."""
    rng, found, rows = random.Random(seed), {}, []
    for _ in range(n_permutations):
        order = rng.sample(range(m), m)
        for walk in (order, order[::-1]):
            mask = 0
            for i in walk:
                rows.append((i, found.setdefault(mask, len(found)), -1.0))
                mask |= 1 << i
                rows.append((i, found.setdefault(mask, len(found)), 1.0))
    out = np.zeros((m, len(found)))
    for i, at, sign in rows:
        out[i, at] += sign / (2 * n_permutations)
    return list(found), out


#: The column of a background that weighs its rows, if it has one.
WEIGHT = "background_weight"


def background_rows(background: DataFrame, features: list[str]) -> tuple[list[tuple], list[float], T.StructType]:
    """The background's rows and weights on the driver: 1 to MAX_BACKGROUND rows, which is checked first."""
    weight = F.col(WEIGHT).cast("double") if WEIGHT in background.columns else F.lit(1.0)
    some = background.select(*features, weight.alias("__weight")).limit(MAX_BACKGROUND + 1)
    rows = some.collect()
    if not 0 < len(rows) <= MAX_BACKGROUND:
        raise ValueError(f"a background has 1 to {MAX_BACKGROUND} rows; compact or sample it first")
    rows = sorted(map(tuple, rows), key=repr)
    return [r[:-1] for r in rows], [r[-1] for r in rows], T.StructType(some.schema.fields[:-1])


def coalition_values(observations: DataFrame, id_name: str, weight: Column, background: DataFrame, model: Model, masks: list[int]) -> DataFrame:
    """id, ``weight`` and ``v_<output>_<coalition>`` for each output and coalition (numbered in order).

    The background is a constant of the plan, so each row's values are computed
    where the row lies: without a join or a shuffle, and whatever its id.
    """
    features = model.feature_names
    rows, weights, schema = background_rows(background, features)
    shares = [w / sum(weights) for w in weights]
    names = [f"v_{o}_{k}" for k in range(len(masks)) for o in range(len(model.output_names))]
    if isinstance(model, ColumnModel):
        # one array of structs for all rows of the background, folded once, and one pass over it for all coalitions
        cells = [F.struct(*[_literal(v, f.dataType).alias(f"f{i}") for i, (v, f) in enumerate(zip(r, schema.fields))], F.lit(s).alias("share")) for r, s in zip(rows, shares)]
        own = [F.col(f"`{f}`") for f in features]
        mixed = lambda mask, b: {f: own[i] if mask >> i & 1 else b[f"f{i}"] for i, f in enumerate(features)}
        every = lambda b: F.array(*[b["share"] * c for mask in masks for c in model.columns(mixed(mask, b))])
        means = F.aggregate(F.array(*cells), F.array(*[F.lit(0.0)] * len(names)), lambda total, b: F.zip_with(total, every(b), lambda x, y: x + y))
        found = observations.select(F.col(id_name), weight.alias("weight"), means.alias("__means"))
        return found.select(id_name, "weight", *[F.col("__means")[k].alias(n) for k, n in enumerate(names)])
    if isinstance(model, PandasModel):
        return _pandas_values(observations, id_name, weight, rows, shares, model, masks, names)
    # models that only transform frames: one row for each coalition and background row, counted per partition before the shuffle
    spark = observations.sparkSession
    back = spark.createDataFrame([(*r, s) for r, s in zip(rows, shares)], T.StructType([*[T.StructField(f"__b_{f.name}", f.dataType) for f in schema.fields], T.StructField("__share", T.DoubleType())]))
    pairs = observations.select(F.monotonically_increasing_id().alias("__row"), F.col(id_name), weight.alias("__w"), *[F.col(f"`{f}`").alias(f"__x_{f}") for f in features]).join(F.broadcast(back))
    hybrids = F.explode(F.array(*[F.struct(F.lit(k).alias("__k"), *[F.col(f"__x_{f}" if mask >> i & 1 else f"__b_{f}").alias(f) for i, f in enumerate(features)]) for k, mask in enumerate(masks)]))
    scored = model.predict(pairs.select("__row", id_name, "__w", "__share", hybrids.alias("h")).select("__row", id_name, "__w", "__share", "h.*"), [f"__y_{o}" for o in range(len(model.output_names))])
    sums = [F.sum(F.when(F.col("__k") == k, F.col("__share") * F.col(f"__y_{o}"))).alias(f"v_{o}_{k}") for k in range(len(masks)) for o in range(len(model.output_names))]
    return scored.groupBy("__row", id_name).agg(F.first("__w").alias("weight"), *sums).drop("__row")


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


def _pandas_values(observations: DataFrame, id_name: str, weight: Column, rows: list[tuple], shares: list[float], model: PandasModel, masks: list[int], names: list[str]) -> DataFrame:
    """Values of a vectorised model: each batch is scored where it lies, one coalition at a time."""
    features, function, share = list(model.feature_names), model.function, np.array(shares)
    picked = observations.select(F.col(id_name), weight.cast("double").alias("weight"), *[F.col(f"`{f}`").alias(f"__x_{i}") for i, f in enumerate(features)])
    schema = T.StructType([*picked.schema.fields[:2], *[T.StructField(n, T.DoubleType()) for n in names]])
    step = max(1, HYBRID_ROWS // len(rows))

    def run(frames):
        import pandas as pd

        back = pd.DataFrame(rows, columns=features)
        for frame in frames:
            for lo in range(0, len(frame), step):
                part = frame.iloc[lo : lo + step]
                n = len(part)
                out = part.iloc[:, :2].reset_index(drop=True)
                for k, mask in enumerate(masks):
                    hybrid = pd.DataFrame({f: part[f"__x_{i}"].repeat(len(back)).to_numpy() if mask >> i & 1 else pd.concat([back[f]] * n).to_numpy() for i, f in enumerate(features)})
                    y = function(hybrid)
                    y = np.asarray(getattr(y, "values", y), float).reshape(n, len(back), -1)
                    for o, mean in enumerate(np.einsum("b,nbo->on", share, y)):
                        out[f"v_{o}_{k}"] = mean
                yield out[[f.name for f in schema.fields]]

    return picked.mapInPandas(run, schema)


def linear(coefficients: np.ndarray, output: int) -> Column:
    total = None
    for k, c in enumerate(coefficients.tolist()):
        if c:
            term = F.lit(c) * F.col(f"v_{output}_{k}")
            total = term if total is None else total + term
    return F.lit(0.0) if total is None else total


def attribute(observations: DataFrame, id_name: str, background: DataFrame, model: Model, masks: list[int], single: np.ndarray, pairs: np.ndarray | None = None, weight: Column | None = None) -> ShapFrame:
    values = coalition_values(observations, id_name, F.lit(1.0) if weight is None else weight, background, model, masks)
    m = len(model.feature_names)
    rows = []
    for o, name in enumerate(model.output_names):
        cells = [linear(single[i], o).alias(f"phi_{i}") for i in range(m)]
        if pairs is not None:
            cells += [linear(pairs[i, j], o).alias(f"int_{i}_{j}") for i in range(m) for j in range(i, m)]
        rows.append(F.struct(F.lit(name).alias("output"), *cells))
    frame = values.select(id_name, "weight", F.explode(F.array(*rows)).alias("r")) if len(rows) > 1 else values.select(id_name, "weight", rows[0].alias("r"))
    return ShapFrame(frame.select(id_name, "weight", "r.*"), id_name, list(model.feature_names), list(model.output_names), pairs is not None)
