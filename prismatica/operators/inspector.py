"""Inspectors: attributions of a model on a sample, and the global metrics drawn from them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import affinity as metrics
from .coalitions import ShapFrame
from .explain import ExactExplainerFactory, ExplainerFactory, TreeExplainerFactory
from .linkage import LinkageTree, link
from .models import ColumnModel, MlModelAdapter, Model, as_model
from .sample import Sample

VARIANT = {(False, False): "rel", (False, True): "abs", (True, False): "rel_sym", (True, True): "abs_sym"}


@dataclass
class Matrix:
    """A feature matrix of one output: rows by rows, with importances and names in order."""

    values: np.ndarray
    names: list[str]
    weights: list[float]
    output: str
    value_label: str

    def to_rows(self) -> list[tuple[str, str, float | None]]:
        return [(a, b, None if np.isnan(self.values[i, j]) else float(self.values[i, j])) for i, a in enumerate(self.names) for j, b in enumerate(self.names)]


class ModelInspector:
    def __init__(self, model: Model, *, explainer_factory: ExplainerFactory, shap_interaction: bool = True, background: DataFrame | None = None):
        if not explainer_factory.explains_raw_output:
            raise ValueError(f"{explainer_factory!r} does not explain raw output")
        self.model, self.factory, self.background = model, explainer_factory, background
        self.shap_interaction = shap_interaction and explainer_factory.supports_shap_interaction_values
        self.shap_: ShapFrame | None = None

    def fit(self, sample: Sample, persist: bool = True) -> ModelInspector:
        """Compute the attributions of all rows, keep them (spilling to disk) and check them.

        Without ``persist`` they are only planned: computed, unchecked, whenever they are read.
        """
        if sample.id_name is None:
            raise ValueError("inspection needs a sample with an id column")
        if len(sample.target_names) > 1:
            raise ValueError(f"inspection takes one target, not {sample.target_names}")
        if unknown := set(sample.feature_names) ^ set(self.model.feature_names):
            raise ValueError(f"the model's features differ from the sample's: {sorted(unknown)}")
        background = sample.features if self.background is None and self.factory.uses_background_dataset else self.background
        shap = self.factory.explain(self.model, sample.frame, sample.id_name, background, interactions=self.shap_interaction, weight=sample.weight_column)
        if persist:
            shap.frame = shap.frame.persist(StorageLevel.MEMORY_AND_DISK)
            # one row a feature
            if lacking := {r["feature"]: r["n_missing"] for r in sample.null_audit().collect() if r["n_missing"] and r["feature"] in sample.feature_names}:
                warnings.warn(f"features with missing values: {lacking}", stacklevel=2)
        self.sample_, self.shap_ = sample, shap
        if persist:
            self.check_values()
            if self.model.kind == "classifier":
                self.check_additivity()
        return self

    @property
    def is_fitted(self) -> bool:
        return self.shap_ is not None

    def _shap(self) -> ShapFrame:
        if self.shap_ is None:
            raise RuntimeError("the inspector is not fitted")
        return self.shap_

    @property
    def feature_names(self) -> list[str]:
        return self._shap().feature_names

    @property
    def output_names(self) -> list[str]:
        return self._shap().output_names

    def shap_values(self) -> DataFrame:
        return self._shap().values()

    def shap_interaction_values(self) -> DataFrame:
        return self._shap().interaction_values()

    def check_values(self) -> None:
        """Raise if an attribution is NaN."""
        shap = self._shap()
        bad = shap.frame.agg(F.max(F.greatest(*[F.isnan(f"phi_{i}").cast("int") for i in range(len(shap.feature_names))], F.lit(0)))).first()[0]
        if bad:
            raise AssertionError("SHAP values contain NaN")

    def additivity(self) -> DataFrame:
        """``(output, least, most)`` of predictions less the sum of their attributions: one value, the expected output, if these add up."""
        shap = self._shap()
        outputs = [f"__y_{o}" for o in range(len(shap.output_names))]
        predicted = self.model.predict(self.sample_.frame.select(shap.id_name, *self.model.feature_names), outputs)
        cells = F.explode(F.array(*[F.struct(F.lit(name).alias("output"), F.col(y).alias("y")) for name, y in zip(shap.output_names, outputs)]))
        predicted = predicted.select(shap.id_name, cells.alias("c")).select(shap.id_name, "c.*")
        total = sum((F.col(f"phi_{i}") for i in range(1, len(shap.feature_names))), F.col("phi_0"))
        gap = F.col("y") - total
        return predicted.join(shap.frame, [shap.id_name, "output"]).groupBy("output").agg(F.min(gap).alias("least"), F.max(gap).alias("most"))

    def check_additivity(self, tolerance: float = 1e-6) -> None:
        """Warn if attributions don't add up to predictions."""
        for r in self.additivity().collect():  # one row an output
            if r["most"] - r["least"] > tolerance * max(1.0, abs(r["least"]), abs(r["most"])):
                warnings.warn(f"attributions of {r['output']} don't add up: predictions less their sum range from {r['least']:.6g} to {r['most']:.6g}", stacklevel=2)

    def feature_importance(self, method: str = "rms") -> DataFrame:
        return metrics.importance(self._shap(), method)

    def feature_interaction_matrix(self) -> DataFrame:
        return metrics.interaction_matrix(self._shap())

    def affinity(self, metric: str) -> DataFrame:
        return metrics.affinity(self._shap(), metric)

    def _matrix(self, metric: str, absolute: bool, symmetrical: bool, clustered: bool) -> list[Matrix]:
        names = self.feature_names
        # M * M rows an output
        rows = self.affinity(metric).collect()
        weights = {(r["output"], r["feature"]): r["importance"] for r in self.feature_importance().collect()}
        out = []
        for output in self.output_names:
            own = [weights[output, f] for f in names]
            values = self._array(rows, output, VARIANT[symmetrical, absolute])
            order = link(self._array(rows, output, "rel_sym"), names, own).leaves() if clustered and len(names) > 1 else list(range(len(names)))
            out.append(Matrix(values[np.ix_(order, order)], [names[i] for i in order], [own[i] for i in order], output, f"{'absolute' if absolute else 'relative'} {metric}"))
        return out

    def _array(self, rows, output: str, variant: str) -> np.ndarray:
        at = {f: i for i, f in enumerate(self.feature_names)}
        values = np.full((len(at), len(at)), np.nan)
        for r in rows:
            if r["output"] == output and r[variant] is not None:
                values[at[r["feature_i"]], at[r["feature_j"]]] = r[variant]
        return values

    def feature_association_matrix(self, *, absolute: bool = False, symmetrical: bool = False, clustered: bool = True) -> list[Matrix]:
        return self._matrix("association", absolute, symmetrical, clustered)

    def feature_synergy_matrix(self, *, absolute: bool = False, symmetrical: bool = False, clustered: bool = True) -> list[Matrix]:
        return self._matrix("synergy", absolute, symmetrical, clustered)

    def feature_redundancy_matrix(self, *, absolute: bool = False, symmetrical: bool = False, clustered: bool = True) -> list[Matrix]:
        return self._matrix("redundancy", absolute, symmetrical, clustered)

    def _linkage(self, metric: str) -> list[LinkageTree]:
        rows = self.affinity(metric).collect()
        weights = {(r["output"], r["feature"]): r["importance"] for r in self.feature_importance().collect()}
        return [link(self._array(rows, o, "rel_sym"), self.feature_names, [weights[o, f] for f in self.feature_names]) for o in self.output_names]

    def feature_association_linkage(self) -> list[LinkageTree]:
        return self._linkage("association")

    def feature_synergy_linkage(self) -> list[LinkageTree]:
        return self._linkage("synergy")

    def feature_redundancy_linkage(self) -> list[LinkageTree]:
        return self._linkage("redundancy")

    def shap_plot_data(self) -> DataFrame:
        """Attributions with the features and target of their rows."""
        shap = self._shap()
        columns = self.sample_.frame.select(shap.id_name, *[F.col(f).alias(f"feature__{f}") for f in self.feature_names], *self.sample_.target_names)
        return shap.frame.select(shap.id_name, "output", *[F.col(f"phi_{i}").alias(f"phi__{f}") for i, f in enumerate(self.feature_names)]).join(columns, shap.id_name)


class LearnerInspector(ModelInspector):
    """Inspects a fitted MLlib model or pipeline; explains trees by default."""

    def __init__(self, model, feature_names=None, *, explainer_factory: ExplainerFactory | None = None, shap_interaction: bool = True, background: DataFrame | None = None, output_names=None):
        adapter = model if isinstance(model, MlModelAdapter) else MlModelAdapter(model, feature_names or [], output_names)
        super().__init__(adapter, explainer_factory=explainer_factory or TreeExplainerFactory(), shap_interaction=shap_interaction, background=background)


class NativeLearnerInspector(LearnerInspector):
    """As LearnerInspector, for bare models: outputs are ``y``, or ``y_0, y_1, ...``."""

    def __init__(self, model, feature_names, **options):
        adapter = MlModelAdapter(model, feature_names)
        names = ["y"] if len(adapter.output_names) == 1 else [f"y_{i}" for i in range(len(adapter.output_names))]
        super().__init__(MlModelAdapter(model, feature_names, names), **options)


class FunctionInspector(ModelInspector):
    """Inspects any function of Columns, or a model adapter; exact explainer by default."""

    def __init__(self, function, feature_names=None, *, explainer_factory: ExplainerFactory | None = None, shap_interaction: bool = True, background: DataFrame | None = None):
        model = function if isinstance(function, (ColumnModel, Model)) else as_model(function, feature_names)
        super().__init__(model, explainer_factory=explainer_factory or ExactExplainerFactory(), shap_interaction=shap_interaction, background=background)
