import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatica.functions.ordering import numbered, quantiles
from prismatica.functions.scalars import ceil_step
from prismatica.operators import affinity, coalitions, tree_shap
from prismatica.operators.explain import ExactExplainerFactory
from prismatica.operators.linkage import link
from prismatica.operators.models import ColumnModel, MlModelAdapter, PandasModel
from prismatica.operators.partition import CategoryPartitioner, ContinuousRangePartitioner, IntegerRangePartitioner
from prismatica.operators.resample import BootstrapCV, StationaryBootstrapCV, StratifiedBootstrapCV
from prismatica.operators.sample import Sample
from prismatica.operators.selection import ParameterSpace
from prismatica.operators.simulate import UnivariateUpliftSimulator


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, *map(float, rng.normal(size=4))) for i in range(60)], "id long, a double, b double, c double, y double")


def f(x):
    return x["a"] * x["b"] + 0.5 * x["c"] + 0.2 * x["b"] * x["c"]


def test_sample_roles_and_errors(rows):
    s = Sample(rows, target_name="y", id_name="id")
    assert s.feature_names == ["a", "b", "c"] and s.drop("b").feature_names == ["a", "c"] and len(s) == 60
    assert Sample(rows, target_name="y", weight_name="y", id_name="id").weight_name == "y"
    for error, call in ((ValueError, lambda: Sample([1], target_name="y")), (KeyError, lambda: Sample(rows, target_name="q")), (KeyError, lambda: Sample(rows, target_name="y", feature_names=["y"])), (ValueError, lambda: s.keep("q")), (ValueError, lambda: s.subsample())):
        with pytest.raises(error):
            call()
    assert len(s.subsample(iloc=[0, 0, 5])) == 3 and len(s.subsample(iloc=slice(10, 20))) == 10 and len(s.subsample(loc=[1, 2])) == 2


def test_positions_and_quantiles_equal_numpy(spark):
    values = [float(v) for v in np.random.default_rng(2).normal(size=501)]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "v double")
    assert quantiles(df, "v", [0.25, 0.75, 1.0]) == pytest.approx(np.quantile(values, [0.25, 0.75, 1.0]))
    placed = numbered(df.filter(F.col("v").isNotNull() & ~F.isnan("v")), ["v"]).orderBy("pos").collect()
    assert [r.v for r in placed] == sorted(values) and [r.pos for r in placed] == list(range(501))


def test_partitions(spark):
    np.random.seed(42)
    n = spark.createDataFrame([(int(v),) for v in np.random.randint(0, 10000, 150)], "v long")
    p = IntegerRangePartitioner().fit(n, "v")
    assert p.bounds == [(i * 1000 - 500, i * 1000 + 500) for i in range(11)] and sum(p.frequencies) == 150
    assert ceil_step(0.3) == 0.5 and ceil_step(1.0) == 1 and ceil_step(2500) == 5000
    with pytest.raises(ValueError, match="hardly vary"):
        ContinuousRangePartitioner().fit(spark.createDataFrame([(1.0,)] * 4 + [(10.0,)], "v double"), "v")
    with pytest.raises(ValueError, match="no values"):
        ContinuousRangePartitioner().fit(n.limit(0), "v")
    assert CategoryPartitioner(2).fit(spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "v string"), "v").values == ["b", "c"]


def test_uplift_of_functions_of_columns_and_pandas_agree(rows):
    s = Sample(rows, target_name="y", id_name="id")
    # a local function: workers don't import this module
    models = [ColumnModel(f, ["a", "b", "c"]), PandasModel(lambda x: x["a"] * x["b"] + 0.5 * x["c"] + 0.2 * x["b"] * x["c"], ["a", "b", "c"])]
    one, two = ([tuple(r)[2:6] for r in UnivariateUpliftSimulator(m, s).simulate_feature("a", ContinuousRangePartitioner(6)).frame.orderBy("partition_idx").collect()] for m in models)
    assert np.allclose(one, two) and len(one) > 2
    with pytest.raises(ValueError):
        UnivariateUpliftSimulator(models[0], s).simulate_feature("q", ContinuousRangePartitioner())


def test_shap_adds_up_and_interactions_sum(rows):
    shap = ExactExplainerFactory().explain(ColumnModel(f, ["a", "b", "c"]), rows, "id", rows, interactions=True)
    data = rows.toPandas().set_index("id")
    out = shap.frame.toPandas().set_index("id").loc[data.index]
    y = f(data)
    assert np.allclose(out[["phi_0", "phi_1", "phi_2"]].sum(axis=1) + np.mean([f({"a": a, "b": b, "c": c}) for a, b, c in data[["a", "b", "c"]].to_numpy()]), y)
    assert np.allclose(out["int_0_0"] + out["int_0_1"] + out["int_0_2"], out["phi_0"])
    for metric in ("association", "synergy", "redundancy"):
        cells = {(r.feature_i, r.feature_j): r.rel for r in affinity.affinity(shap, metric).collect()}
        assert len(cells) == 9 and all(-1e-9 <= v <= 1 + 1e-9 for v in cells.values() if v is not None)


def test_linear_maps_agree():
    rng = np.random.default_rng(3)
    for m in (2, 3, 5):
        v = rng.normal(size=2**m)
        masks, exact = coalitions.exact_coefficients(m)
        kernel_masks, kernel = coalitions.kernel_coefficients(m)
        assert np.allclose(exact @ v[masks], kernel @ v[kernel_masks])
        assert np.allclose(coalitions.interaction_coefficients(m).sum(axis=1) @ v, exact @ v)


def test_tree_shap_equals_brute_force(rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="x"), RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=3, maxDepth=3, seed=1)]).fit(rows)
    adapter = MlModelAdapter(model, ["a", "b", "c"])
    parts, x = tree_shap.leaves(adapter.learner), rows.select("a", "b", "c").toPandas().to_numpy()
    phi, pair = tree_shap.leaf_values(x, parts, 3, 1, True)
    predicted = np.array([r.prediction for r in model.transform(rows).collect()])
    assert np.allclose(phi[:, 0].sum(axis=1) + tree_shap.expected_value(parts)[0], predicted) and np.allclose(pair.sum(axis=3), phi)

    def value(row, s):
        return sum(p.value[0] * math.prod((float(tree_shap.takes(row[None, f : f + 1][:, 0], t)[0]) if f in s else z) for f, t, z in zip(p.features, p.tests, p.zero)) for p in parts)

    for row, own in zip(x[:5], phi[:5, 0]):
        for i in range(3):
            rest = [k for k in range(3) if k != i]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value(row, {*s, i}) - value(row, set(s))) for n in range(3) for s in itertools.combinations(rest, n))
            assert own[i] == pytest.approx(want)


def test_bootstraps(rows):
    drawn = BootstrapCV(40, 1).index(rows, ["id"])
    share = 1 - drawn.distinct().select("split", "pos").distinct().count() / (40 * 60)
    assert drawn.count() == 2400 and 0.33 < share < 0.4
    labelled = rows.withColumn("k", (F.col("id") % 10 == 0).cast("int"))
    counts = StratifiedBootstrapCV(3, 1, stratum="k").train(labelled, ["id"]).groupBy("split").agg(F.sum("k").alias("n")).collect()
    assert [r.n for r in counts] == [6, 6, 6]
    steps = StationaryBootstrapCV(2, 1, mean_block_size=10).index(rows, ["id"]).orderBy("split", "slot").collect()
    assert sum((b.pos - a.pos) % 60 == 1 for a, b in zip(steps, steps[1:])) > 90
    for bad in (1, 1.5, True):
        with pytest.raises((ValueError, TypeError)):
            StationaryBootstrapCV(2, 1, mean_block_size=bad)


def test_linkage_and_spaces(spark):
    tree = link(np.array([[0, 0.9, 0.1], [0.9, 0, 0.2], [0.1, 0.2, 0]]), ["a", "b", "c"], [0.5, 0.3, 0.2])
    assert tree.clusters(0.7) == [["a", "b"]] and [tree.names[i] for i in tree.leaves()] == ["a", "b", "c"]
    from pyspark.ml.regression import LinearRegression

    from pyspark.ml import Pipeline

    inner = ParameterSpace(Pipeline(stages=[Pipeline(stages=[LinearRegression()])]))
    inner.stage0__LinearRegression__regParam = [0.3]
    (choice,) = inner.candidates()
    assert inner.build(choice).getStages()[0].getStages()[0].getRegParam() == 0.3
    space = ParameterSpace(LinearRegression())
    space.regParam = [0.1, 0.2]
    assert len(space.candidates()) == 2
    with pytest.raises(AttributeError):
        space.nothing = [1]
    with pytest.raises(TypeError):
        space.regParam = 3


def test_quantiles_of_ties_and_few_values(spark, monkeypatch):
    import numpy as np

    from prismatica.functions import ordering

    rng = np.random.default_rng(3)
    monkeypatch.setattr(ordering, "FEW", 50)
    for values in (rng.normal(size=3000), rng.integers(0, 3, 3000), np.r_[np.zeros(2000), rng.normal(size=500), np.ones(1500)], [7.0], [1.0, 2.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        assert ordering.quantiles(df, "x", [0, 0.1, 0.25, 0.5, 0.75, 1]) == pytest.approx(np.quantile(values, [0, 0.1, 0.25, 0.5, 0.75, 1]).tolist())
    assert ordering.quantiles(df.filter("x is null"), "x", [0.5]) is None


def test_weighted_background_counts_every_cluster(spark):
    from prismatica.operators.explain import compacted

    # one large cluster and many of a single row: none may be left out
    points = [(0.0, 0.0)] * 3000 + [(100.0 + 50 * i, 0.0) for i in range(9)]
    centres = compacted(spark.createDataFrame(points, "a double, b double"), ["a", "b"], 10, seed=5).collect()
    assert sum(r[coalitions.WEIGHT] for r in centres) == len(points)
    assert sum(r.a * r[coalitions.WEIGHT] for r in centres) == pytest.approx(sum(a for a, _ in points))
    model = ColumnModel(lambda x: x["a"] + 2 * x["b"], ["a", "b"])
    back = spark.createDataFrame([(1.0, 0.0, 3.0), (5.0, 2.0, 1.0)], f"a double, b double, {coalitions.WEIGHT} double")
    (row,) = ExactExplainerFactory().explain(model, spark.createDataFrame([(1, 4.0, 1.0)], "id int, a double, b double"), "id", back).frame.collect()
    assert (row.phi_0, row.phi_1) == pytest.approx((2.0, 1.0))


def test_attribution_needs_no_join_and_no_shuffle(spark, rows):
    background = rows.groupBy((F.col("id") % 3).alias("g")).agg(*[F.avg(c).alias(c) for c in "abc"])
    shap = ExactExplainerFactory().explain(ColumnModel(f, ["a", "b", "c"]), spark.range(100).selectExpr("id", "rand(1) a", "rand(2) b", "rand(3) c"), "id", background)
    plan = shap.frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    # rows that repeat an id keep their own values
    twice = rows.filter("id < 2").withColumn("id", F.lit(0))
    out = ExactExplainerFactory().explain(ColumnModel(f, ["a", "b", "c"]), twice, "id", background).frame
    assert out.count() == 2 and out.select("phi_0").distinct().count() == 2


def test_models_of_all_kinds_have_equal_attributions(rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y", solver="normal")]).fit(rows)
    w, z = model.stages[-1].coefficients.toArray().tolist(), float(model.stages[-1].intercept)
    models = [ColumnModel(lambda x: x["a"] * w[0] + x["b"] * w[1] + x["c"] * w[2] + z, ["a", "b", "c"]), PandasModel(lambda x: x["a"] * w[0] + x["b"] * w[1] + x["c"] * w[2] + z, ["a", "b", "c"]), MlModelAdapter(model, ["a", "b", "c"])]
    frames = [ExactExplainerFactory().explain(m, rows, "id", rows.limit(7)).frame.orderBy("id").toPandas()[["phi_0", "phi_1", "phi_2"]] for m in models]
    assert np.allclose(frames[0], frames[1]) and np.allclose(frames[0], frames[2])


def test_sampled_kernel_is_close_to_exact():
    m = 13
    weights = np.random.default_rng(4).normal(size=m)
    masks, kernel = coalitions.kernel_coefficients(m, n_samples=2048)
    assert len(masks) <= 2048 + 2
    # additive games are recovered exactly from any sample that determines them
    v = np.array([sum(weights[i] for i in range(m) if s >> i & 1) for s in masks])
    assert np.allclose(kernel @ v, weights)


def test_splits_that_draw_every_row_are_drawn_again(spark):
    two = spark.createDataFrame([(1,), (2,)], "id long")
    cv = BootstrapCV(200, 3)
    with pytest.warns(UserWarning, match="groups"):
        drawn = cv.index(two, ["id"], groups="g")
    assert drawn.groupBy("split").agg(F.count_distinct("pos").alias("n"), F.count("*").alias("slots")).filter("n <> 1 or slots <> 2").isEmpty()
    assert drawn.select("split").distinct().count() == 200 and cv.test(two, ["id"]).count() == 200
    some = cv.index(two, ["id"], splits=[5, 9]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in drawn.collect() if r.split in (5, 9))
    assert StationaryBootstrapCV(20, 1, mean_block_size=0.9).test(two, ["id"]).select("split").distinct().count() == 20


def test_selection_with_groups_searchers_and_best_estimator(spark, rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from prismatica.operators import selection

    sample = Sample(rows.withColumn("y", F.col("a") * 2).withColumn("g", F.col("id") % 6), target_name="y", feature_names=["a", "b", "c"], id_name="id")
    sample.frame = sample.frame.join(rows.select("id", (F.col("id") % 6).alias("g")), "id")
    space = ParameterSpace(Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), LinearRegression(labelCol="y")]))
    space.LinearRegression__regParam = [0.0, 5.0]
    scoring = RegressionEvaluator(labelCol="y", metricName="r2")
    found = selection.LearnerSelector(space, cv=selection.KFoldCV(2), scoring=scoring).fit(sample, groups="g")
    assert found.best_candidate_.parameters == {"LinearRegression__regParam": 0.0} and found.best_estimator_ is found.best_estimator_
    ids = rows.select("id", (F.col("id") % 6).alias("g"))
    again = selection.LearnerSelector(space, cv=selection.KFoldCV(2), scoring=scoring).fit(sample, groups=ids)
    assert [r[2] for r in again.results_] == pytest.approx([r[2] for r in found.results_])
    with pytest.raises(ValueError, match="differ"):
        selection.LearnerSelector(space, scoring=scoring).fit(sample, groups=ids.limit(3))
    drawn = selection.LearnerSelector(space, cv=selection.BootstrapSplits(BootstrapCV(2, 1)), scoring=scoring, searcher=selection.random_search, n_iter=3, random_state=1).fit(sample)
    assert len(drawn.candidates_) == 3 and len(drawn.results_) == 6
    report = selection.nested(found.summary_report())
    assert report.schema["score"].dataType["test"].dataType.fieldNames() == ["mean", "std", "rank"]
    for error, options in ((TypeError, {"nothing": 1}), (ValueError, {"space": 1})):
        with pytest.raises(error):
            selection.LearnerSelector(space, scoring=scoring, **options)
    with pytest.raises(TypeError):
        selection.LearnerSelector(space, scoring=scoring, searcher=3)


def test_inspectors_check_what_they_get(spark, rows):
    from prismatica.operators.inspector import FunctionInspector, LearnerInspector

    sample, model = Sample(rows, target_name="y", feature_names=["a", "b", "c"], id_name="id"), ColumnModel(f, ["a", "b", "c"])
    inspector = FunctionInspector(model, background=rows.limit(5))
    with pytest.raises(RuntimeError):
        inspector.shap_values()
    inspector.fit(sample)
    assert inspector.is_fitted and inspector.feature_importance().count() == 3
    for symmetrical, absolute in itertools.product((False, True), repeat=2):
        (matrix,) = inspector.feature_synergy_matrix(symmetrical=symmetrical, absolute=absolute)
        assert sorted(matrix.names) == ["a", "b", "c"] and np.isnan(np.diag(matrix.values)).all()
    with pytest.raises(ValueError, match="one target"):
        FunctionInspector(ColumnModel(f, ["a", "b"]), background=rows).fit(Sample(rows, target_name=["y", "c"], feature_names=["a", "b"], id_name="id"))
    with pytest.raises(ValueError, match="differ"):
        FunctionInspector(model, background=rows).fit(sample.drop("a"))
    with pytest.warns(UserWarning, match="background rows lack"):
        FunctionInspector(model, background=rows.withColumn("a", F.when(F.col("id") > 3, F.col("a")))).fit(sample, persist=False)
    holes = Sample(rows.withColumn("a", F.when(F.col("id") > 3, F.col("a")).otherwise(F.lit(float("nan")))), target_name="y", feature_names=["a", "b", "c"], id_name="id")
    with pytest.warns(UserWarning, match="missing values"), pytest.raises(AssertionError):
        FunctionInspector(model, background=rows.limit(5)).fit(holes)
    with pytest.raises((ValueError, TypeError)):
        LearnerInspector(object(), ["a"])


def test_drawing_reading_and_streaming(spark, rows, tmp_path):
    import io

    from prismatica.operators.draw import SimulationDrawer, SimulationReportStyle
    from prismatica.sources.files import read_sample, read_table, write_sample
    from prismatica.streaming.simulation import predict_stream, simulate_each_batch, windowed_histogram

    sample = Sample(rows, target_name="y", feature_names=["a", "b", "c"], id_name="id")
    write_sample(sample, str(tmp_path / "s.parquet"))
    assert len(read_sample(spark, str(tmp_path / "s.parquet"), target_name="y", id_name="id")) == 60
    (tmp_path / "t.tsv").write_text("x\ty\n1\tb\n")
    assert read_table(spark, str(tmp_path / "t.tsv")).collect() == [(1, "b")]
    model, out = ColumnModel(f, ["a", "b", "c"]), io.StringIO()
    result = UnivariateUpliftSimulator(model, sample).simulate_feature("a", ContinuousRangePartitioner(5))
    SimulationDrawer(SimulationReportStyle(out)).draw(result)
    text = out.getvalue()
    assert "2.5th percentile" in text and "97.5th percentile" in text and "Baseline = 0" in text and text.count("\n") > len(result.partitioning.values)
    with pytest.raises(KeyError):
        SimulationDrawer("oil")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s.parquet"))
    seen = []
    predicted = predict_stream(stream, model, ["p"])
    query = simulate_each_batch(predicted, lambda batch: batch.agg(F.avg("p").alias("m")), lambda frame, number: seen.append((number, frame.first().m)), str(tmp_path / "c"))
    query.awaitTermination(60)
    assert seen == [(0, pytest.approx(rows.select(f({c: F.col(c) for c in "abc"}).alias("p")).agg(F.avg("p")).first()[0]))]
    assert windowed_histogram(rows.withColumn("t", F.timestamp_seconds("id")), "t", ContinuousRangePartitioner(5).fit(rows, "a")).agg(F.sum("frequency")).first()[0] <= 60


def test_histogram_of_a_stream_equals_that_of_its_table(spark, rows, tmp_path):
    from prismatica.streaming.simulation import windowed_histogram

    timed = rows.withColumn("t", F.timestamp_seconds(F.col("id") * 3600))
    timed.write.parquet(str(tmp_path / "in"))
    partitions = ContinuousRangePartitioner(5).fit(rows, "a")
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
    query = windowed_histogram(stream, "t", partitions).writeStream.format("memory").queryName("histogram").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = windowed_histogram(timed, "t", partitions)
    assert sorted(map(tuple, spark.table("histogram").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
