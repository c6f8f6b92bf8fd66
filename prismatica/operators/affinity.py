"""Global metrics from per-row attributions, by moments alone.

Association, synergy and redundancy need only uncentred weighted second
moments, which one aggregate gives; orthogonalised interaction vectors are never
built. Results are rows of ``(output, feature_i, feature_j, rel, abs, rel_sym,
abs_sym)`` with nulls on the diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clipped_sqrt, guarded
from .coalitions import ShapFrame

#: Denominators of the orthogonalisation below this share of their scale count as 0.
TINY = 1e-12


def importance(shap: ShapFrame, method: str = "rms") -> DataFrame:
    """``(output, feature, importance)``: shares of root-mean-square or mean absolute SHAP values."""
    if method not in ("rms", "mav"):
        raise ValueError(f"importance is measured by rms or mav, not by {method}")
    w = F.col("weight")
    total = lambda x: F.sqrt(F.avg(w * x * x)) if method == "rms" else F.avg(w * F.abs(x))
    one = shap.frame.groupBy("output").agg(*[total(F.col(f"phi_{i}")).alias(f"t_{i}") for i in range(len(shap.feature_names))])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"t_{i}").alias("t")) for i, f in enumerate(shap.feature_names)]))
    return one.select("output", cells.alias("c")).select("output", "c.feature", guarded(F.col("c.t"), F.sum("c.t").over(Window.partitionBy("output"))).alias("importance"))


def interaction_matrix(shap: ShapFrame) -> DataFrame:
    """``(output, feature_i, feature_j, interaction)`` for i >= j; an output's cells sum to 1."""
    shap._need()
    m, w = len(shap.feature_names), F.col("weight")
    pairs = [(i, j) for i in range(m) for j in range(i + 1)]
    root = lambda i, j: F.sqrt(F.avg(w * F.pow(F.col(f"int_{j}_{i}"), F.lit(2.0)))) * (1.0 if i == j else 2.0)
    one = shap.frame.groupBy("output").agg(*[root(i, j).alias(f"t_{i}_{j}") for i, j in pairs])
    cells = F.explode(F.array(*[F.struct(F.lit(shap.feature_names[i]).alias("feature_i"), F.lit(shap.feature_names[j]).alias("feature_j"), F.col(f"t_{i}_{j}").alias("t")) for i, j in pairs]))
    return one.select("output", cells.alias("c")).select("output", "c.feature_i", "c.feature_j", guarded(F.col("c.t"), F.sum("c.t").over(Window.partitionBy("output"))).alias("interaction"))


def moments(shap: ShapFrame) -> DataFrame:
    """One row per output, with ``m_<x>_<y>`` for the products needed: partial sums before one tiny shuffle."""
    m = len(shap.feature_names)
    name = lambda i, j: f"int_{min(i, j)}_{max(i, j)}"
    pairs = {(f"phi_{i}", f"phi_{j}") for i in range(m) for j in range(i, m)}
    if shap.interactions:
        for i in range(m):
            for j in range(i, m):
                pairs.add((name(i, i), name(j, j)))
                pairs |= {(name(k, k), name(i, j)) for k in (i, j)} | {(name(i, j), name(i, j))}
                pairs |= {(f"phi_{i}", name(i, j)), (f"phi_{j}", name(i, j)), (f"phi_{i}", name(j, j)), (f"phi_{j}", name(i, i))}
    w = F.col("weight")
    products = {_moment(x, y): F.sum(w * F.col(x) * F.col(y)) / F.sum(w) for x, y in pairs}
    return shap.frame.groupBy("output").agg(*[c.alias(n) for n, c in sorted(products.items())])


def _moment(x: str, y: str) -> str:
    return "m_" + "_".join(sorted((x, y)))


def _m(x: str, y: str) -> Column:
    return F.col(_moment(x, y))


def relative(shap: ShapFrame, metric: str) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """One row per output, and over it the relative affinity of each ordered pair of features.

    Slopes, residual moments and metrics are named columns of steps of their
    own, so that no expression is repeated inside another.
    """
    m, one = len(shap.feature_names), moments(shap)
    inter = lambda i, j: f"int_{min(i, j)}_{max(i, j)}"
    p = lambda i: f"phi_{i}"
    pairs = [(i, j) for i in range(m) for j in range(m) if i != j]
    if metric == "association":
        return one, {(i, j): guarded(_m(p(i), p(j)) * _m(p(i), p(j)), _m(p(i), p(i)) * _m(p(j), p(j))) for i, j in pairs}
    if metric not in ("synergy", "redundancy"):
        raise ValueError(f"unknown metric: {metric}")

    def slope(i: int, j: int) -> Column:
        """The part of the interaction that follows main effect i."""
        ii, jj, ij = inter(i, i), inter(j, j), inter(i, j)
        den = _m(ii, jj) * _m(ii, jj) - _m(ii, ii) * _m(jj, jj)
        num = _m(ii, jj) * _m(jj, ij) - _m(ii, ij) * _m(jj, jj)
        return F.when(den < -TINY * _m(ii, ii) * _m(jj, jj), num / den).otherwise(F.lit(0.0))

    def square(i: int, j: int) -> Column:
        """Moment of the orthogonalised interaction with itself."""
        ii, jj, ij = inter(i, i), inter(j, j), inter(i, j)
        a, b = F.col(f"a_{i}_{j}"), F.col(f"a_{j}_{i}")
        return F.greatest(_m(ij, ij) + a * a * _m(ii, ii) + b * b * _m(jj, jj) - 2 * a * _m(ii, ij) - 2 * b * _m(jj, ij) + 2 * a * b * _m(ii, jj), F.lit(0.0))

    def with_main(i: int, j: int) -> Column:
        """Moment of p_i with the orthogonalised interaction of i and j."""
        return _m(p(i), inter(i, j)) - F.col(f"a_{i}_{j}") * _m(p(i), inter(i, i)) - F.col(f"a_{j}_{i}") * _m(p(i), inter(j, j))

    one = one.select("*", *[slope(i, j).alias(f"a_{i}_{j}") for i, j in pairs])
    one = one.select("*", *[square(i, j).alias(f"q_{i}_{j}") for i, j in pairs], *[with_main(i, j).alias(f"u_{i}_{j}") for i, j in pairs])
    one = one.select("*", *[guarded(F.col(f"u_{i}_{j}"), F.col(f"q_{i}_{j}")).alias(f"c_{i}_{j}") for i, j in pairs], *[guarded(F.col(f"u_{i}_{j}") * F.col(f"u_{i}_{j}"), _m(p(i), p(i)) * F.col(f"q_{i}_{j}")).alias(f"y_{i}_{j}") for i, j in pairs])
    if metric == "synergy":
        return one, {(i, j): F.col(f"y_{i}_{j}") for i, j in pairs}
    one = one.select("*", *[(_m(p(i), p(i)) - F.col(f"c_{i}_{j}") * F.col(f"u_{i}_{j}")).alias(f"d_{i}_{j}") for i, j in pairs], *[(_m(p(i), p(j)) - F.col(f"c_{i}_{j}") * F.col(f"u_{j}_{i}")).alias(f"e_{i}_{j}") for i, j in pairs])
    return one, {(i, j): guarded(F.col(f"e_{i}_{j}") * F.col(f"e_{i}_{j}"), F.col(f"d_{i}_{j}") * F.col(f"d_{j}_{i}")) * (1 - F.col(f"y_{i}_{j}")) for i, j in pairs}


def affinity(shap: ShapFrame, metric: str) -> DataFrame:
    """All four variants of a metric for all pairs."""
    if metric != "association":
        shap._need()
    m, names = len(shap.feature_names), shap.feature_names
    one, cells = relative(shap, metric)
    rel = one.select("output", *[clipped_sqrt(_m(f"phi_{i}", f"phi_{i}")).alias(f"s_{i}") for i in range(m)], *[c.alias(f"r_{i}_{j}") for (i, j), c in cells.items()])
    total = sum((F.col(f"s_{k}") for k in range(1, m)), F.col("s_0"))
    rel = rel.select("*", *[guarded(F.col(f"s_{i}"), total).alias(f"w_{i}") for i in range(m)])
    share = lambda i: F.col(f"w_{i}")
    rows = []
    for i in range(m):
        for j in range(m):
            if i == j:
                values = (F.lit(None).cast("double"),) * 4  # undefined
            else:
                a, b = share(i) * F.col(f"r_{i}_{j}"), share(j) * F.col(f"r_{j}_{i}")
                values = (F.col(f"r_{i}_{j}"), a, F.when(a + b > 0, guarded(a + b, share(i) + share(j))).otherwise(F.lit(0.0)), (a + b) / 2)
            rows.append(F.struct(F.lit(names[i]).alias("feature_i"), F.lit(names[j]).alias("feature_j"), *[v.alias(n) for v, n in zip(values, ("rel", "abs", "rel_sym", "abs_sym"))]))
    return rel.select("output", F.explode(F.array(*rows)).alias("c")).select("output", "c.*")
