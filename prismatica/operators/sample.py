"""Observations with roles: features, one or more targets, an optional weight."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.scalars import present


class Sample:
    """A lazy DataFrame whose columns have roles.

    ``id_name`` names the column that identifies an observation; it is no
    feature unless it is named as one. Feature names default to all columns
    without another role.
    """

    def __init__(self, observations: DataFrame, *, target_name: str | Sequence[str], feature_names: Sequence[str] | None = None, weight_name: str | None = None, id_name: str | None = None):
        if not hasattr(observations, "select") or not hasattr(observations, "schema"):
            raise ValueError(f"observations are a data frame, not a {type(observations).__name__}")
        targets = [target_name] if isinstance(target_name, str) else list(target_name)
        if not targets:
            raise ValueError("name at least one target")
        self._check(observations, "target", targets)
        if weight_name is not None:
            self._check(observations, "weight", [weight_name])
        if id_name is not None:
            self._check(observations, "id", [id_name])
        if feature_names is None:
            features = [c for c in observations.columns if c not in {*targets, weight_name, id_name}]
        else:
            features = list(feature_names)
            self._check(observations, "feature", features)
            if both := sorted(set(features) & set(targets)):
                raise KeyError(f"targets {both} are also features")
        self.feature_names, self.target_names, self.weight_name, self.id_name = features, targets, weight_name, id_name
        roles = [*([id_name] if id_name else []), *features, *targets, *([weight_name] if weight_name else [])]
        self.frame = observations.select(*dict.fromkeys(roles))

    @staticmethod
    def _check(df: DataFrame, role: str, names: Iterable[str]) -> None:
        if missing := sorted(set(names) - set(df.columns)):
            raise KeyError(f"observations have no {role} columns {missing}")

    @property
    def target_name(self) -> str | list[str]:
        return self.target_names[0] if len(self.target_names) == 1 else self.target_names

    def _with_id(self, names: list[str]) -> DataFrame:
        return self.frame.select(*dict.fromkeys([*([self.id_name] if self.id_name else []), *names]))

    @property
    def index(self) -> DataFrame:
        if not self.id_name:
            raise ValueError("the sample has no id column")
        return self.frame.select(self.id_name)

    @property
    def features(self) -> DataFrame:
        return self._with_id(self.feature_names)

    @property
    def target(self) -> DataFrame:
        return self._with_id(self.target_names)

    @property
    def weight(self) -> DataFrame | None:
        return self._with_id([self.weight_name]) if self.weight_name else None

    @property
    def weight_column(self) -> Column:
        return F.col(self.weight_name).cast("double") if self.weight_name else F.lit(1.0)

    def __len__(self) -> int:
        return self.frame.count()

    def _like(self, frame: DataFrame, features: list[str] | None = None) -> Sample:
        return Sample(frame, target_name=self.target_names if len(self.target_names) > 1 else self.target_names[0], feature_names=self.feature_names if features is None else features, weight_name=self.weight_name, id_name=self.id_name)

    def keep(self, feature_names: str | Sequence[str]) -> Sample:
        """Only these features, in this order."""
        names = [feature_names] if isinstance(feature_names, str) else list(feature_names)
        if unknown := sorted(set(names) - set(self.feature_names)):
            raise ValueError(f"unknown features: {unknown}")
        return self._like(self.frame, names)

    def drop(self, feature_names: str | Sequence[str]) -> Sample:
        """All features but these, in the original order."""
        names = {feature_names} if isinstance(feature_names, str) else set(feature_names)
        if unknown := sorted(names - set(self.feature_names)):
            raise ValueError(f"unknown features: {unknown}")
        return self._like(self.frame, [f for f in self.feature_names if f not in names])

    def subsample(self, *, loc=None, iloc=None) -> Sample:
        """Rows by ``loc`` (a predicate, or ids) or by ``iloc`` (positions in id order, repeats kept).

        Ids and positions may be a list, a slice or a DataFrame of one column.
        """
        if (loc is None) == (iloc is None):
            raise ValueError("pass exactly one of loc and iloc")
        if isinstance(loc, Column):
            return self._like(self.frame.filter(loc))
        if not self.id_name:
            raise ValueError("the sample has no id column")
        if loc is not None:
            if isinstance(loc, slice):
                test = F.lit(True)
                if loc.start is not None:
                    test = test & (F.col(self.id_name) >= loc.start)
                if loc.stop is not None:  # labels: the end is included
                    test = test & (F.col(self.id_name) <= loc.stop)
                return self._like(self.frame.filter(test))
            ids = loc if isinstance(loc, DataFrame) else self.frame.sparkSession.createDataFrame([(x,) for x in loc], [self.id_name])
            return self._like(self.frame.join(ids.toDF(self.id_name), self.id_name))
        placed = numbered(self.frame, [self.id_name], "__pos")
        if isinstance(iloc, slice):
            if (iloc.step or 1) < 1 or (iloc.start or 0) < 0 or (iloc.stop or 0) < 0:
                raise ValueError("position slices go forward from 0")
            test = F.col("__pos") >= (iloc.start or 0)
            if iloc.stop is not None:
                test = test & (F.col("__pos") < iloc.stop)
            if iloc.step:
                test = test & ((F.col("__pos") - (iloc.start or 0)) % iloc.step == 0)
            return self._like(placed.filter(test).drop("__pos"))
        at = iloc if isinstance(iloc, DataFrame) else self.frame.sparkSession.createDataFrame([(int(x),) for x in iloc], ["__pos"])
        return self._like(placed.join(at.toDF("__pos"), "__pos").drop("__pos"))

    def null_audit(self) -> DataFrame:
        """Per feature: rows, and rows that are null or NaN; one pass."""
        counts = [F.count_if(~present(f)).alias(f) for f in self.feature_names]
        one = self.frame.agg(F.count(F.lit(1)).alias("__rows"), *counts)
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("n_missing")) for f in self.feature_names]))
        return one.select(F.col("__rows").alias("n_rows"), pairs.alias("x")).select("x.feature", "n_rows", "x.n_missing")

    def without_missing(self) -> Sample:
        """Rows whose features are all there (as a background needs)."""
        test = F.lit(True)
        for f in self.feature_names:
            test = test & present(f)
        return self._like(self.frame.filter(test))
