"""Path-dependent tree SHAP over MLlib trees, leaf by leaf.

A leaf's contribution is a product game: with the features on its path, v(S) is
the leaf value times the product of z_i (the share of training rows that take
the path's branches on i) over features outside S and of o_i (whether x takes
them) inside S. Shapley values of products follow from elementary symmetric
polynomials, vectorised over the rows of an Arrow batch. Node tables have a
size fixed by the model and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coalitions import ShapFrame
from .models import MlModelAdapter


@dataclass
class Leaf:
    value: np.ndarray  # by output
    features: list[int]
    zero: np.ndarray  # share by feature
    tests: list[list[tuple[float | frozenset, bool]]]  # by feature: threshold or left categories, goes left


def leaves(model) -> list[Leaf]:
    """All leaves of an MLlib tree model, with values weighted by their tree."""
    trees = list(getattr(model, "trees", [model]))
    weights = list(getattr(model, "treeWeights", [1.0] * len(trees)))
    boosted = type(model).__name__.startswith("GBT")
    classes = getattr(model, "numClasses", None)
    out: list[Leaf] = []

    def value(node) -> np.ndarray:
        if classes and not boosted:
            stats = np.array(node.impurityStats().stats())
            share = stats / stats.sum()
            return share[1:2] if classes == 2 else share
        return np.array([node.prediction()])

    def count(node) -> float:
        return float(node.impurityStats().rawCount())

    def walk(node, weight, path):
        if node.getClass().getSimpleName() == "LeafNode":
            features = sorted({f for f, *_ in path})
            zero = np.array([np.prod([share for f, share, _, _ in path if f == g]) for g in features])
            tests = [[(test, left) for f, _, test, left in path if f == g] for g in features]
            out.append(Leaf(weight * value(node), features, zero, tests))
            return
        split = node.split()
        test = split.threshold() if split.getClass().getSimpleName() == "ContinuousSplit" else frozenset(split.leftCategories())
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            walk(child, weight, [*path, (split.featureIndex(), count(child) / count(node), test, left)])

    scale = 1.0 if boosted else 1.0 / len(trees)
    for tree, weight in zip(trees, weights):
        walk(tree._call_java("rootNode"), weight * scale if boosted else scale, [])
    return out


def takes(column: np.ndarray, tests) -> np.ndarray:
    on = np.ones(len(column), bool)
    for test, left in tests:
        goes = np.isin(column, list(test)) if isinstance(test, frozenset) else column <= test
        on &= goes if left else ~goes
    return on


def symmetric(one: np.ndarray, zero: np.ndarray, without: set[int]) -> np.ndarray:
    """Coefficients of prod(zero_i + one_i t) over the features not left out: rows x degree."""
    poly = np.ones((len(one), 1))
    for i in range(one.shape[1]):
        if i not in without:
            grown = np.zeros((len(one), poly.shape[1] + 1))
            grown[:, :-1] += poly * zero[i]
            grown[:, 1:] += poly * one[:, i : i + 1]
            poly = grown
    return poly


def leaf_values(x: np.ndarray, parts: list[Leaf], m: int, outputs: int, interactions: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """SHAP values (rows, outputs, m) and interaction values (rows, outputs, m, m)."""
    phi = np.zeros((len(x), outputs, m))
    pair = np.zeros((len(x), outputs, m, m)) if interactions else None
    for leaf in parts:
        d = len(leaf.features)
        one = np.stack([takes(x[:, f], t) for f, t in zip(leaf.features, leaf.tests)], 1).astype(float) if d else np.zeros((len(x), 0))
        single = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
        for a, f in enumerate(leaf.features):
            gain = (one[:, a] - leaf.zero[a]) * (symmetric(one, leaf.zero, {a}) @ single)
            phi[:, :, f] += gain[:, None] * leaf.value[None, :]
            for b in range(a) if interactions else ():
                g = leaf.features[b]
                double = np.array([factorial(k) * factorial(d - k - 2) / factorial(d - 1) / 2 for k in range(d - 1)])
                both = (one[:, a] - leaf.zero[a]) * (one[:, b] - leaf.zero[b]) * (symmetric(one, leaf.zero, {a, b}) @ double)
                pair[:, :, f, g] += both[:, None] * leaf.value[None, :]
                pair[:, :, g, f] += both[:, None] * leaf.value[None, :]
    if interactions:
        at = np.arange(m)
        pair[:, :, at, at] = phi - pair.sum(axis=3)
    return phi, pair


def expected_value(parts: list[Leaf]) -> np.ndarray:
    return sum(p.value * np.prod(p.zero) for p in parts)


def explain_trees(model: MlModelAdapter, observations: DataFrame, id_name: str, interactions: bool = False, weight=None) -> ShapFrame:
    """Attributions of raw output: margins of boosted trees, class shares of forests, values of regressors."""
    from pyspark.ml.functions import vector_to_array

    parts = leaves(model.learner)
    outputs = model.output_names
    context = observations.sparkSession.sparkContext
    shared = context.broadcast(parts)
    m = len(model.feature_names)
    ready = model.preprocess(observations)
    rows = ready.select(F.col(id_name), (F.lit(1.0) if weight is None else weight).alias("weight"), vector_to_array(F.col(model.learner.getFeaturesCol())).alias("__x"))
    names = [f"phi_{i}" for i in range(m)] + ([f"int_{i}_{j}" for i in range(m) for j in range(i, m)] if interactions else [])
    schema = T.StructType([rows.schema[id_name], T.StructField("weight", T.DoubleType()), T.StructField("output", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(frames):
        import pandas as pd

        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo : lo + 1024]
                phi, pair = leaf_values(np.stack(part["__x"].to_numpy()), shared.value, m, len(outputs), interactions)
                for o, output in enumerate(outputs):
                    cells = {f"phi_{i}": phi[:, o, i] for i in range(m)}
                    if interactions:
                        cells |= {f"int_{i}_{j}": pair[:, o, i, j] for i in range(m) for j in range(i, m)}
                    yield pd.DataFrame({id_name: part[id_name].to_numpy(), "weight": part["weight"].to_numpy(), "output": output, **cells})

    return ShapFrame(rows.mapInPandas(run, schema), id_name, list(model.feature_names), list(outputs), interactions)
