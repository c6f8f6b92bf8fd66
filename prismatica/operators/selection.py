"""Search over hyperparameter spaces of MLlib estimators, and the ranked report."""

from __future__ import annotations

import inspect
import itertools
import random
import time
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_draw
from .sample import Sample


class Uniform:
    """A continuous distribution of parameter values."""

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high

    def rvs(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)

    def __repr__(self) -> str:
        return f"Uniform({self.low!r}, {self.high!r})"


class ParameterSpace:
    """Choices for an estimator's parameters, set as attributes; a pipeline's stages by ``<stage>__<parameter>``."""

    def __init__(self, estimator, candidate_name: str | None = None):
        self.__dict__.update(estimator=estimator, candidate_name=candidate_name, values={})

    def __setattr__(self, name: str, value) -> None:
        self._param(name)
        if not isinstance(value, (list, tuple)) and not hasattr(value, "rvs"):
            raise TypeError(f"choices for {name} are a list or a distribution, not {value!r}")
        self.values[name] = list(value) if isinstance(value, (list, tuple)) else value

    def __getattr__(self, name: str):
        if name.startswith("__") or name not in self.__dict__.get("values", {}):
            raise AttributeError(name)
        return self.values[name]

    def _param(self, name: str):
        """The parameter that ``stage__...__parameter`` names, down through pipelines inside pipelines."""
        owner, at = self.estimator, name
        while "__" in at and isinstance(owner, Pipeline):
            stage, at = at.split("__", 1)
            stages = {type(s).__name__: s for s in owner.getStages()} | {f"stage{i}": s for i, s in enumerate(owner.getStages())}
            if stage not in stages:
                raise AttributeError(f"unknown stage: {stage}")
            owner = stages[stage]
        if not owner.hasParam(at):
            raise AttributeError(f"unknown parameter: {name}")
        return owner.getParam(at)

    @property
    def name(self) -> str:
        return self.candidate_name or default_name(self.estimator)

    def candidates(self) -> list[dict]:
        """All combinations; distributions can't be listed."""
        if drawn := [n for n, v in self.values.items() if hasattr(v, "rvs")]:
            raise TypeError(f"a grid needs lists, but {drawn} are distributions")
        return [dict(zip(self.values, c)) for c in itertools.product(*self.values.values())]

    def draw(self, rng: random.Random) -> dict:
        return {n: v.rvs(rng) if hasattr(v, "rvs") else rng.choice(v) for n, v in self.values.items()}

    def build(self, parameters: dict):
        """A copy of the estimator with these parameters."""
        return self.estimator.copy({self._param(n): v for n, v in parameters.items()})

    def to_expression(self) -> str:
        return f"{type(self).__name__}({', '.join([self.name, *(f'{k}={v!r}' for k, v in self.values.items())])})"

    __repr__ = to_expression


class MultiEstimatorParameterSpace:
    """Several spaces; all estimators predict the same kind of target."""

    def __init__(self, *spaces: ParameterSpace):
        if not spaces:
            raise TypeError("no parameter space passed")
        if len({kind_of(s.estimator) for s in spaces}) > 1:
            raise TypeError("all estimators must be of the same type: regressors or classifiers")
        self.spaces = list(spaces)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(map(repr, self.spaces))})"


def learner_of(estimator):
    return estimator.getStages()[-1] if isinstance(estimator, Pipeline) else estimator


def kind_of(estimator) -> str:
    learner = learner_of(estimator)
    return "classifier" if learner.hasParam("rawPredictionCol") else "regressor"


def default_name(estimator) -> str:
    return type(learner_of(estimator)).__name__


class KFoldCV:
    """Folds by a hash of the id, or of a row's group."""

    def __init__(self, n_splits: int = 5, random_state: int = 0):
        if n_splits < 2:
            raise ValueError("two folds are the least")
        self.n_splits, self.seed = n_splits, random_state

    def splits(self, sample: Sample, groups: str | None = None):
        fold = hash_draw(self.n_splits, self.seed, F.col(groups or sample.id_name))
        for k in range(self.n_splits):
            yield sample.frame.filter(fold != k), sample.frame.filter(fold == k)


class BootstrapSplits:
    """Wraps a bootstrap as a splitter; each split draws only its own slots."""

    def __init__(self, bootstrap):
        self.bootstrap, self.n_splits = bootstrap, bootstrap.n_splits

    def splits(self, sample: Sample, groups: str | None = None):
        if groups is not None:
            warnings.warn(f"bootstraps have no groups; left out: {groups!r}", stacklevel=2)
        order = [sample.id_name]
        for k in range(self.n_splits):
            yield self.bootstrap.train(sample.frame, order, [k]).drop("split", "slot"), self.bootstrap.test(sample.frame, order, [k]).drop("split")


@dataclass(frozen=True)
class Candidate:
    """A space and one choice of its parameters: an estimator that can be fitted like any other."""

    space: ParameterSpace
    parameters: dict

    @property
    def name(self) -> str:
        return self.space.name

    @property
    def estimator(self):
        return self.space.build(self.parameters)

    def fit(self, frame: DataFrame):
        return self.estimator.fit(frame)

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v!r}' for k, v in self.parameters.items())})"


def grid(space: MultiEstimatorParameterSpace) -> list[Candidate]:
    """All combinations of all spaces."""
    return [Candidate(s, p) for s in space.spaces for p in s.candidates()]


def random_search(space: MultiEstimatorParameterSpace, n_iter: int = 10, random_state: int = 0) -> list[Candidate]:
    """Seeded draws from the spaces."""
    rng = random.Random(random_state)
    return [Candidate(s, s.draw(rng)) for s in (rng.choice(space.spaces) for _ in range(n_iter))]


def randomized(n_iter: int = 10, random_state: int = 0) -> Callable:
    return partial(random_search, n_iter=n_iter, random_state=random_state)


class LearnerSelector:
    """Fits every candidate on every split; candidates are independent Spark jobs of a thread pool.

    ``scoring`` is an Evaluator or a callable from a frame of predictions to a number.
    """

    def __init__(self, parameter_space, *, cv=None, scoring: Evaluator | Callable, searcher: Callable = grid, parallelism: int = 4, greater_is_better: bool | None = None, **searcher_params):
        if not callable(searcher):
            raise TypeError(f"a searcher is callable, not {type(searcher).__name__}")
        first, *known = inspect.signature(searcher).parameters
        if first in searcher_params:
            raise ValueError(f"{first} is the space, which the selector passes itself")
        if unknown := sorted(set(searcher_params) - set(known)):
            raise TypeError(f"the searcher doesn't take {unknown}")
        spaces = list(parameter_space) if isinstance(parameter_space, Sequence) else [parameter_space]
        self.space = spaces[0] if len(spaces) == 1 and isinstance(spaces[0], MultiEstimatorParameterSpace) else MultiEstimatorParameterSpace(*spaces)
        self.cv, self.scoring, self.parallelism = cv or KFoldCV(), scoring, parallelism
        self.searcher = partial(searcher, **searcher_params)
        self.greater = greater_is_better if greater_is_better is not None else (scoring.isLargerBetter() if isinstance(scoring, Evaluator) else True)
        self.results_: list[tuple] | None = None

    def fit(self, sample: Sample, groups: str | DataFrame | None = None, **fit_params) -> LearnerSelector:
        """``groups`` stay together in folds: a column of the sample, or a frame of ids and groups that covers it."""
        if "sample_weight" in fit_params:
            raise ValueError("weights are taken from the sample; don't pass sample_weight")
        if sample.id_name is None:
            raise ValueError("selection needs a sample with an id column")
        sample, groups = self._grouped(sample, groups)
        self.best_ = None
        candidates = self.searcher(self.space)
        self.candidates_, self.sample_ = candidates, sample
        score = self.scoring.evaluate if isinstance(self.scoring, Evaluator) else self.scoring

        def one(job):
            split, train, test, number, candidate = job
            estimator = self._weighted(candidate.estimator, sample)
            began = time.perf_counter()
            model = estimator.fit(train)
            fitted = time.perf_counter()
            return number, split, float(score(model.transform(test))), fitted - began, time.perf_counter() - fitted

        self.results_ = []
        with ThreadPoolExecutor(self.parallelism) as pool:
            for split, (train, test) in enumerate(self.cv.splits(sample, groups)):
                train, test = train.persist(), test.persist()
                self.results_ += pool.map(one, [(split, train, test, n, c) for n, c in enumerate(candidates)])
                train.unpersist()
                test.unpersist()
        return self

    @staticmethod
    def _grouped(sample: Sample, groups: str | DataFrame | None) -> tuple[Sample, str | None]:
        if groups is None or isinstance(groups, str):
            if groups is not None and groups not in sample.frame.columns:
                raise KeyError(f"no column {groups}")
            return sample, groups
        ids, name = groups.select(F.col(groups.columns[0]).alias(sample.id_name), F.col(groups.columns[1]).alias("__group")), sample.id_name
        if not ids.join(sample.frame, name, "left_anti").isEmpty() or not sample.frame.join(ids, name, "left_anti").isEmpty():
            raise ValueError("the groups' ids differ from the sample's")
        grouped = copy(sample)
        grouped.frame = sample.frame.join(ids, name)
        return grouped, "__group"

    @staticmethod
    def _weighted(estimator, sample: Sample):
        learner = learner_of(estimator)
        if sample.weight_name and learner.hasParam("weightCol"):
            learner.set(learner.getParam("weightCol"), sample.weight_name)
        return estimator

    def _ranked(self) -> list[tuple[int, float]]:
        if self.results_ is None:
            raise AttributeError("the selector is not fitted")
        means = {}
        for number, _, score, *_ in self.results_:
            means.setdefault(number, []).append(score)
        mean = {k: sum(v) / len(v) for k, v in means.items()}
        return sorted(mean.items(), key=lambda x: (-x[1] if self.greater else x[1], x[0]))

    @property
    def best_candidate_(self) -> Candidate:
        return self.candidates_[self._ranked()[0][0]]

    @property
    def best_estimator_(self):
        """The best candidate, fitted on all rows once."""
        best = self.best_candidate_
        if self.best_ is None:
            self.best_ = self._weighted(best.estimator, self.sample_).fit(self.sample_.frame)
        return self.best_

    def summary_report(self, *, sort_by: str | None = None) -> DataFrame:
        """One row per candidate; an unknown ``sort_by`` leaves the candidates' order."""
        spark: SparkSession = self.sample_.frame.sparkSession
        self._ranked()
        scores = spark.createDataFrame(self.results_, "id int, split int, score double, fit_s double, score_s double")
        listed = spark.createDataFrame([(n, c.name, *[None if c.parameters.get(k) is None else str(c.parameters[k]) for k in self._names()]) for n, c in enumerate(self.candidates_)], ", ".join(["id int", "candidate string", *[f"`param__{k}` string" for k in self._names()]]))
        report = rank_report(scores.groupBy("id"), self.greater).join(listed, "id")
        by = sort_by or "score__test__rank"
        return report.orderBy(by, "id") if by in report.columns else report.orderBy("id")

    def _names(self) -> list[str]:
        return list(dict.fromkeys(k for c in self.candidates_ for k in c.space.values))


def rank_report(grouped, greater: bool = True) -> DataFrame:
    """Mean, spread and rank of scores, and times; ties share the least rank."""
    report = grouped.agg(
        F.avg("score").alias("score__test__mean"),
        F.stddev_pop("score").alias("score__test__std"),
        F.avg("fit_s").alias("time__fit__mean"),
        F.stddev_pop("fit_s").alias("time__fit__std"),
        F.avg("score_s").alias("time__score__mean"),
        F.stddev_pop("score_s").alias("time__score__std"),
    )
    # one row a candidate
    order = F.desc("score__test__mean") if greater else F.asc("score__test__mean")
    return report.withColumn("score__test__rank", F.rank().over(Window.orderBy(order)))


def nested(report: DataFrame) -> DataFrame:
    """Columns ``x__y__z`` as structs: ``x`` with ``y`` with ``z``, in the order of their first column."""

    def level(names: list[tuple[tuple[str, ...], str]]) -> list:
        out, done = [], set()
        for path, column in names:
            if path[0] in done:
                continue
            done.add(path[0])
            below = [(p[1:], c) for p, c in names if p[0] == path[0]]
            out.append(F.col(f"`{column}`").alias(path[0]) if len(below) == 1 and not below[0][0] else F.struct(*level(below)).alias(path[0]))
        return out

    return report.select(*level([(tuple(c.split("__")), c) for c in report.columns]))
