"""Adapters: anything that predicts from named features, as one interface."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model as MlModel
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Model:
    """Adds prediction columns to rows of features."""

    feature_names: list[str] | None
    output_names: list[str]
    kind = "function"

    def predict(self, df: DataFrame, names: list[str]) -> DataFrame:
        """``df`` plus one double column for each name in ``names`` (the outputs, in order)."""
        raise NotImplementedError

    def preprocess(self, df: DataFrame) -> DataFrame:
        return df


class ColumnModel(Model):
    """A function of Columns: stays inside Catalyst and whole-stage code generation.

    ``function`` gets a dict from feature name to Column and returns a Column or,
    for several outputs, a list of Columns.
    """

    def __init__(self, function: Callable[[dict[str, Column]], Column | list[Column]], feature_names: Sequence[str], output_names: Sequence[str] | None = None, kind: str = "function"):
        self.function, self.feature_names, self.kind = function, list(feature_names), kind
        name = getattr(function, "__name__", "output")
        self.output_names = list(output_names) if output_names else ["output" if name == "<lambda>" else name]

    def columns(self, values: dict[str, Column]) -> list[Column]:
        out = self.function(values)
        return [c.cast("double") for c in (out if isinstance(out, (list, tuple)) else [out])]

    def predict(self, df, names):
        return df.select("*", *[c.alias(n) for c, n in zip(self.columns({f: F.col(f) for f in self.feature_names}), names)])


class PandasModel(Model):
    """A vectorised function from a pandas frame of features to an array (rows, or rows x outputs)."""

    def __init__(self, function: Callable, feature_names: Sequence[str], output_names: Sequence[str] | None = None):
        self.function, self.feature_names = function, list(feature_names)
        name = getattr(function, "__name__", "output")
        self.output_names = list(output_names) if output_names else ["output" if name == "<lambda>" else name]

    def predict(self, df, names):
        function, features = self.function, self.feature_names
        schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

        def run(frames):
            for frame in frames:
                if len(frame):
                    values = function(frame[features])
                    values = getattr(values, "values", values)
                    for i, name in enumerate(names):
                        frame[name] = (values if values.ndim == 1 else values[:, i]).astype(float)
                    yield frame

        return df.mapInPandas(run, schema)


class MlModelAdapter(Model):
    """A fitted MLlib model or pipeline whose last stage is a regressor or classifier.

    Regressors predict one output, binary classifiers the probability of the
    positive class (label 1), other classifiers that of each class.
    """

    def __init__(self, model, feature_names: Sequence[str], output_names: Sequence[str] | None = None):
        if isinstance(model, Estimator) or not isinstance(model, MlModel):
            raise ValueError(f"the model is not fitted: {type(model).__name__}")
        self.model, self.feature_names = model, list(feature_names)
        self.stages = list(model.stages) if isinstance(model, PipelineModel) else [model]
        self.learner = self.stages[-1]
        classes = getattr(self.learner, "numClasses", None)
        if classes is not None and classes < 2:
            raise ValueError("the classifier knows only one class")
        self.kind = "classifier" if classes else "regressor"
        if not classes and not self.learner.hasParam("predictionCol"):
            raise TypeError(f"the model is neither a regressor nor a classifier: {type(self.learner).__name__}")
        self.n_classes = classes
        self.output_names = list(output_names) if output_names else (["target"] if not classes else ["1"] if classes == 2 else [str(i) for i in range(classes)])

    def preprocess(self, df):
        for stage in self.stages[:-1]:
            df = stage.transform(df)
        return df

    def predict(self, df, names):
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(df)
        if self.kind == "regressor":
            return scored.select(*df.columns, F.col(self.learner.getPredictionCol()).cast("double").alias(names[0]))
        probability = vector_to_array(F.col(self.learner.getProbabilityCol()))
        at = [1] if self.n_classes == 2 else range(self.n_classes)
        return scored.select(*df.columns, *[probability[i].alias(n) for i, n in zip(at, names)])


def as_model(model, feature_names: Sequence[str] | None = None) -> Model:
    """Adapters as they are, MLlib models wrapped, functions of Columns wrapped; else TypeError."""
    if isinstance(model, Model):
        return model
    if isinstance(model, (MlModel, Estimator)):
        return MlModelAdapter(model, feature_names or [])
    if callable(model):
        if feature_names is None:
            raise ValueError("feature names are needed for a function")
        return ColumnModel(model, feature_names)
    raise TypeError(f"not a model: {type(model).__name__}")
