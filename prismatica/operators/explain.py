"""Explainer factories: exact, kernel, permutation and tree."""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import present
from . import coalitions
from .coalitions import ShapFrame
from .models import MlModelAdapter, Model


def complete(background: DataFrame, features: list[str]) -> DataFrame:
    """Background rows without missing features; a warning tells how many were left out."""
    test = F.lit(True)
    for f in features:
        test = test & present(f)
    missing, total = background.agg(F.count_if(~test), F.count(F.lit(1))).first()
    if missing:
        warnings.warn(f"{missing} of {total} background rows lack a feature and are left out", stacklevel=3)
    return background.filter(test)


class ExplainerFactory(ABC):
    explains_raw_output = True
    supports_shap_interaction_values = False
    uses_background_dataset = True

    @abstractmethod
    def explain(self, model: Model, observations: DataFrame, id_name: str, background: DataFrame | None = None, *, interactions: bool = False, weight=None) -> ShapFrame: ...

    def _ready(self, model: Model, background: DataFrame | None, interactions: bool) -> DataFrame | None:
        if interactions and not self.supports_shap_interaction_values:
            raise ValueError(f"{self!r} does not support interaction values")
        if not self.uses_background_dataset:
            return None
        if background is None:
            raise ValueError(f"{self!r} needs a background dataset")
        return complete(background, model.feature_names)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})"


class ExactExplainerFactory(ExplainerFactory):
    """All coalitions; at most MAX_EXACT features."""

    supports_shap_interaction_values = True

    def explain(self, model, observations, id_name, background=None, *, interactions=False, weight=None):
        background = self._ready(model, background, interactions)
        m = len(model.feature_names)
        if m > coalitions.MAX_EXACT:
            raise ValueError(f"exact explanation takes {coalitions.MAX_EXACT} features at most; use kernel or permutation explainers")
        masks, single = coalitions.exact_coefficients(m)
        return coalitions.attribute(observations, id_name, background, model, masks, single, coalitions.interaction_coefficients(m) if interactions else None, weight)


class KernelExplainerFactory(ExplainerFactory):
    """Weighted least squares; a background above ``data_size_limit`` rows is compacted by k-means.

    All features are kept: there is no selection of the ten strongest.
    """

    def __init__(self, n_samples: int = 2048, data_size_limit: int = 100, seed: int = 0):
        self.n_samples, self.data_size_limit, self.seed = n_samples, data_size_limit, seed

    def explain(self, model, observations, id_name, background=None, *, interactions=False, weight=None):
        background = compacted(self._ready(model, background, interactions), model.feature_names, self.data_size_limit, self.seed)
        masks, single = coalitions.kernel_coefficients(len(model.feature_names), self.n_samples, self.seed)
        return coalitions.attribute(observations, id_name, background, model, masks, single, None, weight)


class PermutationExplainerFactory(ExplainerFactory):
    def __init__(self, n_permutations: int = 10, seed: int = 0):
        self.n_permutations, self.seed = n_permutations, seed

    def explain(self, model, observations, id_name, background=None, *, interactions=False, weight=None):
        background = self._ready(model, background, interactions)
        masks, single = coalitions.permutation_coefficients(len(model.feature_names), self.n_permutations, self.seed)
        return coalitions.attribute(observations, id_name, background, model, masks, single, None, weight)


class TreeExplainerFactory(ExplainerFactory):
    """Path-dependent tree attribution of MLlib trees, forests and boosted trees; explains raw output."""

    supports_shap_interaction_values = True
    uses_background_dataset = False

    def explain(self, model, observations, id_name, background=None, *, interactions=False, weight=None):
        from .tree_shap import explain_trees

        self._ready(model, background, interactions)
        if not isinstance(model, MlModelAdapter):
            raise TypeError("the tree explainer takes MLlib tree models")
        return explain_trees(model, observations, id_name, interactions, weight)


def compacted(background: DataFrame, features: list[str], limit: int, seed: int = 0) -> DataFrame:
    """The background if it has at most ``limit`` rows, else one k-means centre a row, weighted by its cluster's size."""
    if background.limit(limit + 1).count() <= limit:
        return background
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="__features").transform(background.select(*[F.col(f).cast("double") for f in features]))
    model = KMeans(k=limit, seed=seed, featuresCol="__features").fit(data)
    rows = [(*map(float, centre), float(size)) for centre, size in zip(model.clusterCenters(), model.summary.clusterSizes) if size]
    return background.sparkSession.createDataFrame(rows, [*features, coalitions.WEIGHT])
