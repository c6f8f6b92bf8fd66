"""Registered queries of the inspectors, with learners whose trees and lines are known in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resample, selection
from ..operators.inspector import FunctionInspector, LearnerInspector, NativeLearnerInspector
from ..operators.models import ColumnModel
from ..operators.partition import ContinuousRangePartitioner, IntegerRangePartitioner
from ..operators.sample import Sample
from ..operators.simulate import UnivariateProbabilitySimulator, UnivariateTargetSimulator, UnivariateUpliftSimulator
from .catalog import SCORE, good, lineitem, price, query, read, rounded, scored
from .oracles import GAMES, OBSERVATIONS, SHAP, affinity_sql, tree_games

FEATURES = ["a", "b", "c"]

# Trees as (feature, threshold, left, right); a leaf is (training rows, class or value counts). They are what
# training on the small tables below gives, whatever the data they then explain.
LEVELS = {"a": (0.5, 1.5, 2.5, 3.5), "b": (0.25, 0.75), "c": (0.2, 0.6)}
REGRESSION = ("a", 2.0, ("b", 0.5, (4, {0: 1.0}), (4, {0: 3.0})), ("c", 0.4, (4, {0: 8.0}), (4, {0: 12.0})))
BINARY = ("a", 2.0, ("b", 0.5, (4, {0: 1.0, 1: 0.0}), (4, {0: 0.25, 1: 0.75})), (8, {0: 0.0, 1: 1.0}))
CLASSES = ("a", 2.0, (8, {0: 1.0, 1: 0.0, 2: 0.0}), ("c", 0.4, (4, {0: 0.0, 1: 1.0, 2: 0.0}), (4, {0: 0.0, 1: 0.25, 2: 0.75})))


def training(spark, label) -> DataFrame:
    rows = [(a, b, c) for a in LEVELS["a"] for b in LEVELS["b"] for c in LEVELS["c"]]
    return spark.createDataFrame([(*r, float(label(*r))) for r in rows], "a double, b double, c double, label double")


def fitted(spark, learner, label, parameters=None):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=FEATURES, outputCol="x"), learner(featuresCol="x", labelCol="label", maxDepth=2, seed=1, **(parameters or {}))]
    return Pipeline(stages=stages).fit(training(spark, label))


def steps(a, b, c):
    return (1 if b < 0.5 else 3) if a < 2 else (8 if c < 0.4 else 12)


def regressor(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    return fitted(spark, DecisionTreeRegressor, steps)


def forest(spark):
    """Without bootstrap and with all features, every tree of a forest is the same."""
    from pyspark.ml.regression import RandomForestRegressor

    return fitted(spark, RandomForestRegressor, steps, {"numTrees": 3, "bootstrap": False, "featureSubsetStrategy": "all"})


def boosted(spark):
    from pyspark.ml.regression import GBTRegressor

    return fitted(spark, GBTRegressor, steps, {"maxIter": 1})


def binary(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    return fitted(spark, DecisionTreeClassifier, lambda a, b, c: a > 2 or (b > 0.5 and (a > 1 or c > 0.4)))


def classes(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    return fitted(spark, DecisionTreeClassifier, lambda a, b, c: 0 if a < 2 else 1 if c < 0.4 or (b < 0.5 and a < 3) else 2)


def long_sql(outputs: dict[str, str]) -> str:
    """SHAP values of several outputs, each from its own coalition values."""
    return " UNION ALL ".join(f"SELECT * FROM (WITH {OBSERVATIONS}, {games}, {GAMES} SELECT id, '{name}' AS output, feature, round(phi, 6) AS phi FROM l)" for name, games in outputs.items())


@query(long_sql({"target": tree_games(REGRESSION, 0)}))
def inspector_regressor(spark, sf_dir):
    sample, _ = scored(spark, sf_dir)
    return rounded(LearnerInspector(regressor(spark), FEATURES).fit(sample, persist=False).shap_values())


@query(f"WITH {OBSERVATIONS}, {tree_games(REGRESSION, 0)}, {GAMES} SELECT id, 'y' AS output, i AS feature_i, j AS feature_j, round(phi, 6) AS phi FROM k")
def native_inspector_interactions(spark, sf_dir):
    sample, _ = scored(spark, sf_dir)
    return rounded(NativeLearnerInspector(regressor(spark), FEATURES).fit(sample, persist=False).shap_interaction_values())


@query(long_sql({"target": tree_games(REGRESSION, 0)}))
def tree_shap_rf(spark, sf_dir):
    sample, _ = scored(spark, sf_dir)
    return rounded(LearnerInspector(forest(spark), FEATURES).fit(sample, persist=False).shap_values())


@query(long_sql({"target": tree_games(REGRESSION, 0)}))
def tree_shap_gbt(spark, sf_dir):
    sample, _ = scored(spark, sf_dir)
    return rounded(LearnerInspector(boosted(spark), FEATURES).fit(sample, persist=False).shap_values())


@query(long_sql({"1": tree_games(BINARY, 1)}))
def inspector_binary(spark, sf_dir):
    """One output: the share of the positive class."""
    sample, _ = scored(spark, sf_dir)
    return rounded(LearnerInspector(binary(spark), FEATURES).fit(sample, persist=False).shap_values())


@query(long_sql({str(k): tree_games(CLASSES, k) for k in range(3)}))
def inspector_multiclass(spark, sf_dir):
    sample, _ = scored(spark, sf_dir)
    return rounded(LearnerInspector(classes(spark), FEATURES).fit(sample, persist=False).shap_values())


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {OBSERVATIONS}, {tree_games(CLASSES, k)} SELECT '{k}' AS output, round(min(v0), 6) AS least, round(max(v0), 6) AS most FROM v)" for k in range(3)))
def inspector_additivity(spark, sf_dir):
    """Predictions less the sum of their attributions are the expected output everywhere."""
    sample, _ = scored(spark, sf_dir)
    return rounded(LearnerInspector(classes(spark), FEATURES).fit(sample, persist=False).additivity())


def _importances(outputs: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT * FROM (WITH {OBSERVATIONS}, {g}, {GAMES} SELECT '{n}' AS output, feature, sqrt(avg(w * phi * phi)) AS t FROM l GROUP BY feature)" for n, g in outputs.items())
    return f"SELECT output, feature, round(t / sum(t) OVER (PARTITION BY output), 6) AS importance FROM ({parts})"


@query(_importances({str(k): tree_games(CLASSES, k) for k in range(3)}))
def inspector_multiclass_importance(spark, sf_dir):
    sample, _ = scored(spark, sf_dir)
    return rounded(LearnerInspector(classes(spark), FEATURES).fit(sample, persist=False).feature_importance())


def _two(x):
    return [SCORE.function(x), 2.0 * x["a"] - x["c"]]


LINEAR = "SELECT o.id, 'linear' AS output, unnest(['a', 'b', 'c']) AS feature, unnest([round(2 * (o.a - ga), 6), 0.0::DOUBLE, round(gc - o.c, 6)]) AS phi FROM o, (SELECT avg(a) AS ga, avg(c) AS gc FROM g)"


@query(f"WITH {SHAP}, two AS ({LINEAR}) SELECT id, 'score' AS output, feature, round(phi, 6) AS phi FROM l UNION ALL SELECT * FROM two")
def two_outputs(spark, sf_dir):
    """A function of two outputs: one attribution each, the linear one known in closed form."""
    sample, background = scored(spark, sf_dir)
    model = ColumnModel(_two, FEATURES, ["score", "linear"])
    # adding 0 makes negative zeros positive
    return rounded(FunctionInspector(model, background=background, shap_interaction=False).fit(sample, persist=False).shap_values()).withColumn("phi", F.col("phi") + 0.0)


@query(affinity_sql("association"))
def association_without_interactions(spark, sf_dir):
    sample, background = scored(spark, sf_dir)
    return rounded(FunctionInspector(SCORE, background=background, shap_interaction=False).fit(sample, persist=False).affinity("association"))


VARIANTS = [(absolute, symmetrical, name) for absolute, symmetrical, name in ((False, False, "rel"), (True, False, "abs"), (False, True, "rel_sym"), (True, True, "abs_sym"))]


def _matrices(metric: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS variant, '{'absolute' if absolute else 'relative'} {metric}' AS label, feature_i, feature_j, {name} AS value FROM ({affinity_sql(metric)})" for absolute, _, name in VARIANTS)


def matrices(spark, sf_dir, metric: str) -> DataFrame:
    sample, background = scored(spark, sf_dir)
    inspector, rows = FunctionInspector(SCORE, background=background).fit(sample), []
    for absolute, symmetrical, name in VARIANTS:
        (matrix,) = getattr(inspector, f"feature_{metric}_matrix")(absolute=absolute, symmetrical=symmetrical, clustered=False)
        rows += [(name, matrix.value_label, a, b, None if v is None else round(v, 6)) for a, b, v in matrix.to_rows()]
    inspector.shap_.frame.unpersist()
    return spark.createDataFrame(rows, "variant string, label string, feature_i string, feature_j string, value double")


@query(_matrices("synergy"))
def matrix_synergy(spark, sf_dir):
    return matrices(spark, sf_dir, "synergy")


@query(_matrices("redundancy"))
def matrix_redundancy(spark, sf_dir):
    return matrices(spark, sf_dir, "redundancy")


@query(_matrices("association"))
def matrix_association(spark, sf_dir):
    return matrices(spark, sf_dir, "association")


def _merges(metric: str) -> str:
    """Single linkage of three features: the closest pair, then the third next to the closer of them; heavier end first."""
    return f"""x AS (SELECT * FROM ({affinity_sql(metric)})),
cell AS (SELECT ascii(feature_i) - 97 AS i, ascii(feature_j) - 97 AS j, 1 - abs(rel_sym) AS d FROM x WHERE feature_i < feature_j),
imp AS (WITH {SHAP}, u AS (SELECT feature, sqrt(avg(w * phi * phi)) AS t FROM l GROUP BY feature) SELECT feature, ascii(feature) - 97 AS n, t / sum(t) OVER () AS weight FROM u),
pair AS (SELECT i, j, d, 3 - i - j AS z FROM cell ORDER BY d, i, j LIMIT 1),
side AS (SELECT pair.*, (SELECT d FROM cell c WHERE c.i = least(pair.i, z) AND c.j = greatest(pair.i, z)) AS di, (SELECT d FROM cell c WHERE c.i = least(pair.j, z) AND c.j = greatest(pair.j, z)) AS dj FROM pair),
chain AS (SELECT CASE WHEN dj <= di THEN i ELSE j END AS far, CASE WHEN dj <= di THEN j ELSE i END AS near, z, d, least(di, dj) AS e FROM side),
turned AS (SELECT chain.*, (SELECT weight FROM imp WHERE n = far) >= (SELECT weight FROM imp WHERE n = z) AS ahead FROM chain)"""


def _linkage_sql(metric: str) -> str:
    return f"""WITH {_merges(metric)}
SELECT n::INTEGER AS node_id, -1::INTEGER AS left, -1::INTEGER AS right, 0.0::DOUBLE AS distance, 1::INTEGER AS size, feature AS name, round(weight, 6) AS weight FROM imp
UNION ALL SELECT 3, CASE WHEN ahead THEN far ELSE near END, CASE WHEN ahead THEN near ELSE far END, round(d, 6), 2, NULL, NULL FROM turned
UNION ALL SELECT 4, CASE WHEN ahead THEN 3 ELSE z END, CASE WHEN ahead THEN z ELSE 3 END, round(e, 6), 3, NULL, NULL FROM turned"""


def linkage(spark, sf_dir, metric: str) -> DataFrame:
    sample, background = scored(spark, sf_dir)
    (tree,) = getattr(FunctionInspector(SCORE, background=background).fit(sample, persist=False), f"feature_{metric}_linkage")()
    return spark.createDataFrame([(n, -1 if a is None else a, -1 if b is None else b, round(d, 6), s, name, None if w is None else round(w, 6)) for n, a, b, d, s, name, w in tree.rows()], "node_id int, left int, right int, distance double, size int, name string, weight double")


@query(_linkage_sql("redundancy"))
def linkage_redundancy(spark, sf_dir):
    return linkage(spark, sf_dir, "redundancy")


@query(_linkage_sql("synergy"))
def linkage_synergy(spark, sf_dir):
    return linkage(spark, sf_dir, "synergy")


@query(_linkage_sql("association"))
def linkage_association(spark, sf_dir):
    return linkage(spark, sf_dir, "association")


@query(
    f"""WITH {_merges("redundancy")}, leaves AS (SELECT unnest(CASE WHEN ahead THEN [far, near, z] ELSE [z, near, far] END) AS n, generate_subscripts([1, 2, 3], 1) - 1 AS place FROM turned)
SELECT place::INTEGER AS place, feature, round(weight, 6) AS weight FROM leaves JOIN imp USING (n)"""
)
def matrix_order(spark, sf_dir):
    """The order of features of a clustered matrix."""
    sample, background = scored(spark, sf_dir)
    (matrix,) = FunctionInspector(SCORE, background=background).fit(sample, persist=False).feature_redundancy_matrix()
    return spark.createDataFrame([(i, n, round(w, 6)) for i, (n, w) in enumerate(zip(matrix.names, matrix.weights))], "place int, feature string, weight double")


# selection

FOLDS = "(('0x' || substr(md5('0:' || id), 1, 15))::BIGINT % 2)::INTEGER"


@query(
    f"""WITH o AS (SELECT o_orderkey AS id, 1 + o_orderkey % 3 AS w, o_totalprice AS y, month(o_orderdate)::DOUBLE / 12 AS b, (o_custkey % 7)::DOUBLE / 7 AS c FROM orders), s AS (SELECT *, {FOLDS} AS fold FROM o),
k AS (SELECT unnest([0, 1]) AS fold),
e AS (SELECT k.fold, w, y, unnest(['b', 'c']) AS feature, unnest([b, c]) AS x FROM s JOIN k ON s.fold <> k.fold),
q AS (SELECT fold, feature, sum(w * y * x) / sum(w * x * x) AS through, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) AS slope, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM e GROUP BY ALL),
m AS (SELECT fold, any_value(slope) FILTER (feature = 'b') AS sb, any_value(my - slope * mx) FILTER (feature = 'b') AS ib, any_value(through) FILTER (feature = 'b') AS zb, any_value(slope) FILTER (feature = 'c') AS sc, any_value(my - slope * mx) FILTER (feature = 'c') AS ic, any_value(through) FILTER (feature = 'c') AS zc FROM q GROUP BY fold),
p AS (SELECT fold, y, unnest(['line_b', 'line_b', 'line_c', 'line_c']) AS candidate, unnest(['True', 'False', 'True', 'False']) AS param, unnest([ib + sb * b, zb * b, ic + sc * c, zc * c]) AS f FROM s JOIN m USING (fold)),
r AS (SELECT fold, candidate, param, 1 - sum(pow(y - f, 2)) / (count(*) * var_pop(y)) AS score FROM p GROUP BY ALL),
z AS (SELECT candidate, param, avg(score) AS mean, stddev_pop(score) AS std FROM r GROUP BY ALL)
SELECT candidate, param AS param__LinearRegression__fitIntercept, round(mean, 6) AS score__test__mean, round(std, 6) AS score__test__std, (rank() OVER (ORDER BY mean DESC))::INTEGER AS score__test__rank FROM z"""
)
def selector_grid(spark, sf_dir):
    """Straight lines on one feature each, weighted, with and without intercept: the report has closed forms."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    sample, _ = scored(spark, sf_dir)
    spaces = []
    for feature in "bc":
        space = selection.ParameterSpace(Pipeline(stages=[VectorAssembler(inputCols=[feature], outputCol="features"), LinearRegression(labelCol="y", solver="normal", standardization=False)]), f"line_{feature}")
        space.LinearRegression__fitIntercept = [True, False]
        spaces.append(space)
    found = selection.LearnerSelector(spaces, cv=selection.KFoldCV(2), scoring=RegressionEvaluator(labelCol="y", metricName="r2")).fit(sample)
    return rounded(found.summary_report().drop("id", *[f"time__{a}__{b}" for a in ("fit", "score") for b in ("mean", "std")]))



# resampling of rows, baselines

BOOTSTRAP = "('0x' || substr(md5('42:' || split || ':' || slot), 1, 15))::BIGINT"


@query(
    f"""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders), d AS (SELECT split, unnest(range(0, (SELECT count(*) FROM orders))) AS slot FROM range(0, 3) t(split)),
i AS (SELECT split, slot, {BOOTSTRAP} % (SELECT count(*) FROM orders) AS pos FROM d) SELECT split::INTEGER AS split, slot, o_orderkey FROM i JOIN p USING (pos)"""
)
def bootstrap_rows(spark, sf_dir):
    return resample.BootstrapCV(3, 42).train(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    f"""WITH p AS (SELECT doc_id, quality, row_number() OVER (ORDER BY quality, doc_id) - 1 AS pos FROM labels), z AS (SELECT quality, min(pos) AS start, count(*) AS n FROM p GROUP BY quality),
e AS (SELECT start, n, start + unnest(range(0, n)) AS slot FROM z), d AS (SELECT split, slot, start + {BOOTSTRAP} % n AS pos FROM e, range(0, 4) t(split))
SELECT t.split::INTEGER AS split, p.doc_id, p.quality FROM p, range(0, 4) t(split) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.split = t.split AND d.pos = p.pos)"""
)
def bootstrap_stratified_oob(spark, sf_dir):
    return resample.StratifiedBootstrapCV(4, 42, stratum="quality").test(read(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query(
    """WITH d AS (SELECT quality FROM documents JOIN labels USING (doc_id))
SELECT * FROM (VALUES ('target', 'Mean predicted target (l_extendedprice)'), ('uplift', 'Mean predicted uplift (l_extendedprice)'), ('probability', 'probability(1)')) t(simulator, unit)
JOIN (SELECT 'target' AS simulator, round(avg(l_extendedprice), 6) AS baseline FROM lineitem UNION ALL SELECT 'uplift', 0 UNION ALL SELECT 'probability', round(avg((quality = 1)::INTEGER), 6) FROM d) USING (simulator)"""
)
def simulation_baselines(spark, sf_dir):
    """What simulations are compared with: the observed mean, nothing, the observed share of the positive class."""
    items = lineitem(spark, sf_dir)
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    labelled = Sample(rows, target_name="quality", feature_names=["n_chars", "lang"])
    price_model, good_model = ColumnModel(price, ["l_quantity", "l_discount", "l_tax"]), ColumnModel(good, ["n_chars", "lang"], kind="classifier")
    results = {
        "target": UnivariateTargetSimulator(price_model, items).simulate_feature("l_quantity", ContinuousRangePartitioner()),
        "uplift": UnivariateUpliftSimulator(price_model, items).simulate_feature("l_quantity", ContinuousRangePartitioner()),
        "probability": UnivariateProbabilitySimulator(good_model, labelled).simulate_feature("n_chars", IntegerRangePartitioner()),
    }
    return spark.createDataFrame([(n, r.output_unit, round(float(r.baseline), 6)) for n, r in results.items()], "simulator string, unit string, baseline double")
