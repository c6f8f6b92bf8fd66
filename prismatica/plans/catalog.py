"""Registered queries of the attribution engine and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..functions.scalars import hash_draw
from ..operators import affinity, resample, selection
from ..operators.coalitions import ShapFrame
from ..operators.explain import ExactExplainerFactory, KernelExplainerFactory, PermutationExplainerFactory
from ..operators.inspector import FunctionInspector
from ..operators.models import ColumnModel
from ..operators.partition import CategoryPartitioner, ContinuousRangePartitioner, IntegerRangePartitioner
from ..operators.sample import Sample
from ..operators.simulate import UnivariateProbabilitySimulator, UnivariateTargetSimulator, UnivariateUpliftSimulator
from ..streaming.simulation import windowed_histogram
from .oracles import SHAP, affinity_sql, partition_ctes, partition_sql, simulate_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def wrap(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark, sf_dir) -> Sample:
    return Sample(read(spark, sf_dir, "lineitem"), target_name="l_extendedprice", feature_names=["l_quantity", "l_discount", "l_tax"], weight_name="l_quantity")


def orders(spark, sf_dir) -> Sample:
    return Sample(read(spark, sf_dir, "orders"), target_name="o_totalprice", feature_names=["o_orderpriority", "o_orderstatus"], id_name="o_orderkey")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# samples


@query("SELECT l_tax, l_quantity, l_extendedprice FROM lineitem")
def sample_keep(spark, sf_dir):
    return lineitem(spark, sf_dir).keep(["l_tax", "l_quantity"]).frame


@query("SELECT l_discount, l_tax, l_extendedprice, l_quantity FROM lineitem")
def sample_drop(spark, sf_dir):
    return lineitem(spark, sf_dir).drop("l_quantity").frame


@query("SELECT l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem WHERE l_discount >= 0.05")
def sample_subsample_mask(spark, sf_dir):
    return lineitem(spark, sf_dir).subsample(loc=F.col("l_discount") >= 0.05).frame


@query(
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM p JOIN (SELECT c_nationkey * 3 AS pos FROM customer) USING (pos)"""
)
def sample_subsample_positions(spark, sf_dir):
    """Positions repeat, and so do rows."""
    at = read(spark, sf_dir, "customer").select((F.col("c_nationkey") * 3).cast("long").alias("pos"))
    return orders(spark, sf_dir).subsample(iloc=at).frame


@query(
    """SELECT feature, (SELECT count(*) FROM events)::BIGINT AS n_rows, n_missing FROM (
SELECT 'value' AS feature, count(*) FILTER (value IS NULL OR isnan(value)) AS n_missing FROM events UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) FROM events)"""
)
def sample_null_audit(spark, sf_dir):
    return Sample(read(spark, sf_dir, "events"), target_name="event_type", feature_names=["value", "user_id"]).null_audit()


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def sample_positions(spark, sf_dir):
    return numbered(read(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "pos")


# partitions


def ranges(spark, sf_dir, table, column, partitioner=None, **bounds):
    return rounded((partitioner or ContinuousRangePartitioner()).fit(read(spark, sf_dir, table), column, **bounds).frame())


@query(partition_sql("lineitem", "l_extendedprice"))
def partition_continuous(spark, sf_dir):
    return ranges(spark, sf_dir, "lineitem", "l_extendedprice")


@query(partition_sql("events", "value"))
def partition_continuous_outliers(spark, sf_dir):
    return ranges(spark, sf_dir, "events", "value")


@query(partition_sql("lineitem", "l_discount", bounds=(0.02, 0.07)))
def partition_continuous_bounds(spark, sf_dir):
    return ranges(spark, sf_dir, "lineitem", "l_discount", lower_bound=0.02, upper_bound=0.07)


@query(partition_sql("part", "p_size", integer=True))
def partition_integer(spark, sf_dir):
    return ranges(spark, sf_dir, "part", "p_size", IntegerRangePartitioner())


CATEGORY = """SELECT (row_number() OVER (ORDER BY n DESC, v DESC) - 1)::INTEGER AS partition_idx, v AS partition, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, n AS frequency
FROM (SELECT {1} AS v, count(*) AS n FROM {0} GROUP BY 1) ORDER BY n DESC, v DESC LIMIT 20"""


@query(CATEGORY.format("part", "p_brand"))
def partition_category(spark, sf_dir):
    return CategoryPartitioner().fit(read(spark, sf_dir, "part"), "p_brand").frame()


@query(CATEGORY.format("events", "event_type"))
def partition_category_events(spark, sf_dir):
    return CategoryPartitioner().fit(read(spark, sf_dir, "events"), "event_type").frame()


# simulations


def price(x):
    return 1500.0 * x["l_quantity"] * (1 - x["l_discount"]) * (1 + x["l_tax"])


PRICE = "1500.0::DOUBLE * centre * (1 - l_discount) * (1 + l_tax)"
QUANTITY = partition_ctes("lineitem", "l_quantity")


def simulated(result):
    return rounded(result.frame)


@query(simulate_sql(QUANTITY, "lineitem CROSS JOIN p", PRICE, "0"))
def simulate_target(spark, sf_dir):
    return simulated(UnivariateTargetSimulator(ColumnModel(price, ["l_quantity", "l_discount", "l_tax"]), lineitem(spark, sf_dir)).simulate_feature("l_quantity", ContinuousRangePartitioner()))


@query(simulate_sql(QUANTITY, "lineitem CROSS JOIN p", PRICE, "(SELECT avg(l_extendedprice) FROM lineitem)"))
def simulate_uplift(spark, sf_dir):
    return simulated(UnivariateUpliftSimulator(ColumnModel(price, ["l_quantity", "l_discount", "l_tax"]), lineitem(spark, sf_dir)).simulate_feature("l_quantity", ContinuousRangePartitioner()))


def good(x):
    z = -0.5 + x["n_chars"] / 4000.0 + F.when(x["lang"] == "en", 0.3).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


@query(
    simulate_sql(
        "d AS (SELECT n_chars, lang, quality FROM documents JOIN labels USING (doc_id)), " + partition_ctes("d", "n_chars", integer=True),
        "d CROSS JOIN p",
        "1 / (1 + exp(-(-0.5::DOUBLE + centre / 4000 + CASE WHEN lang = 'en' THEN 0.3::DOUBLE ELSE 0 END)))",
        "0",
    ).replace("centre AS partition", "centre::BIGINT AS partition")
)
def simulate_probability(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    sample = Sample(rows, target_name="quality", feature_names=["n_chars", "lang"])
    return simulated(UnivariateProbabilitySimulator(ColumnModel(good, ["n_chars", "lang"], kind="classifier"), sample).simulate_feature("n_chars", IntegerRangePartitioner()))


@query(
    """WITH p AS (SELECT (row_number() OVER (ORDER BY n DESC, v DESC) - 1)::INTEGER AS partition_idx, v AS centre, n AS frequency FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, v DESC LIMIT 20), h AS (SELECT partition_idx, frequency FROM p), """
    + simulate_sql(
        "z AS (SELECT 1)",
        "orders CROSS JOIN p",
        "CASE WHEN centre = '1-URGENT' THEN 300.0::DOUBLE ELSE 100.0::DOUBLE END + CASE WHEN o_orderstatus = 'F' THEN 50.0::DOUBLE ELSE 0 END",
        "0",
    )[5:].replace("frequency::BIGINT", "h.frequency::BIGINT")
)
def simulate_category(spark, sf_dir):
    def cost(x):
        return F.when(x["o_orderpriority"] == "1-URGENT", 300.0).otherwise(100.0) + F.when(x["o_orderstatus"] == "F", 50.0).otherwise(0.0)

    return simulated(UnivariateTargetSimulator(ColumnModel(cost, ["o_orderpriority", "o_orderstatus"]), orders(spark, sf_dir)).simulate_feature("o_orderpriority", CategoryPartitioner()))


@query(
    "WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem), "
    + simulate_sql(QUANTITY, "lineitem CROSS JOIN p CROSS JOIN c", "intercept + slope * centre", "(SELECT avg(l_extendedprice) FROM lineitem)")[5:]
)
def ols_univariate_uplift(spark, sf_dir):
    """A straight line fitted by aggregates, simulated with its coefficients as literals."""
    sample = lineitem(spark, sf_dir).keep(["l_quantity"])
    line = sample.frame.agg(F.regr_slope("l_extendedprice", "l_quantity"), F.regr_intercept("l_extendedprice", "l_quantity")).first()
    return simulated(UnivariateUpliftSimulator(ColumnModel(lambda x: line[1] + line[0] * x["l_quantity"], ["l_quantity"]), sample).simulate_feature("l_quantity", ContinuousRangePartitioner()))


@query(
    "WITH "
    + partition_ctes("events", "value")
    + """ SELECT date_trunc('day', ts) AS day, partition_idx, count(*) AS frequency FROM events JOIN p ON value >= e0 AND value < e1 GROUP BY 1, 2"""
)
def streaming_histogram_batch(spark, sf_dir):
    """The streaming histogram's plan over a bounded table."""
    events = read(spark, sf_dir, "events")
    return windowed_histogram(events, "ts", ContinuousRangePartitioner().fit(events, "value")).select(F.col("window.start").alias("day"), "partition_idx", "frequency")


# attributions


def score(x):
    return x["a"] * x["b"] + 0.5 * x["c"] + 0.3 * x["a"] * x["c"] + 0.2 * x["b"] * x["c"]


SCORE = ColumnModel(score, ["a", "b", "c"])


def scored(spark, sf_dir) -> tuple[Sample, DataFrame]:
    """All orders, and the means of their groups as background (15 rows at most)."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (1 + F.col("o_orderkey") % 3).cast("double").alias("w"),
        (F.col("o_totalprice") / 100000).alias("a"),
        (F.month("o_orderdate").cast("double") / 12).alias("b"),
        ((F.col("o_custkey") % 7).cast("double") / 7).alias("c"),
        F.col("o_totalprice").alias("y"),
        "o_orderpriority",
        "o_orderstatus",
    )
    background = rows.groupBy("o_orderpriority", "o_orderstatus").agg(*[F.avg(f).alias(f) for f in "abc"]).select("a", "b", "c")
    return Sample(rows, target_name="y", feature_names=["a", "b", "c"], weight_name="w", id_name="id"), background


def shap(spark, sf_dir, factory=None, interactions: bool = True, weighted: bool = True) -> ShapFrame:
    sample, background = scored(spark, sf_dir)
    return (factory or ExactExplainerFactory()).explain(SCORE, sample.frame, "id", background, interactions=interactions, weight=sample.weight_column if weighted else None)


LONG = f"WITH {SHAP} SELECT id, 'score' AS output, feature, round(phi, 6) AS phi FROM l"


@query(LONG)
def shap_exact_3(spark, sf_dir):
    return rounded(shap(spark, sf_dir, interactions=False).values())


@query(f"WITH {SHAP} SELECT id, 'score' AS output, i AS feature_i, j AS feature_j, round(phi, 6) AS phi FROM k")
def shap_interactions_3(spark, sf_dir):
    return rounded(shap(spark, sf_dir).interaction_values())


@query(f"WITH {SHAP} SELECT id, 'score' AS output, feature, round(main, 6) AS phi FROM l")
def shap_main_effects(spark, sf_dir):
    return rounded(shap(spark, sf_dir).main_effects())


@query(LONG)
def shap_from_interactions(spark, sf_dir):
    pairs = shap(spark, sf_dir).interaction_values()
    return rounded(pairs.groupBy("id", "output", F.col("feature_i").alias("feature")).agg(F.sum("phi").alias("phi")))


@query(LONG)
def kernel_shap(spark, sf_dir):
    """With three features all coalitions are taken, so the least squares are exact."""
    return rounded(shap(spark, sf_dir, KernelExplainerFactory(), interactions=False).values())


@query(LONG)
def permutation_shap(spark, sf_dir):
    """Two-way interactions only: walks in both directions are exact."""
    return rounded(shap(spark, sf_dir, PermutationExplainerFactory(), interactions=False).values())


def _importance_sql(total: str) -> str:
    return f"WITH {SHAP}, u AS (SELECT feature, {total} AS t FROM l GROUP BY feature) SELECT 'score' AS output, feature, round(t / sum(t) OVER (), 6) AS importance FROM u"


@query(_importance_sql("sqrt(avg(phi * phi))"))
def importance_rms(spark, sf_dir):
    return rounded(affinity.importance(shap(spark, sf_dir, interactions=False, weighted=False)))


@query(_importance_sql("avg(abs(phi))"))
def importance_mav(spark, sf_dir):
    return rounded(affinity.importance(shap(spark, sf_dir, interactions=False, weighted=False), "mav"))


@query(_importance_sql("sqrt(avg(w * phi * phi))"))
def importance_weighted(spark, sf_dir):
    return rounded(affinity.importance(shap(spark, sf_dir, interactions=False)))


@query(affinity_sql("association"))
def affinity_association(spark, sf_dir):
    return rounded(affinity.affinity(shap(spark, sf_dir), "association"))


@query(affinity_sql("synergy"))
def affinity_synergy(spark, sf_dir):
    return rounded(affinity.affinity(shap(spark, sf_dir), "synergy"))


@query(affinity_sql("redundancy"))
def affinity_redundancy(spark, sf_dir):
    return rounded(affinity.affinity(shap(spark, sf_dir), "redundancy"))


@query(
    f"""WITH {SHAP}, u AS (SELECT i, j, sqrt(avg(w * phi * phi)) * CASE WHEN i = j THEN 1 ELSE 2 END AS t FROM k WHERE i >= j GROUP BY i, j)
SELECT 'score' AS output, i AS feature_i, j AS feature_j, round(t / sum(t) OVER (), 6) AS interaction FROM u"""
)
def interaction_matrix(spark, sf_dir):
    return rounded(affinity.interaction_matrix(shap(spark, sf_dir)))


@query(
    f"""WITH {SHAP} SELECT s.id, 'score' AS output, round(pa, 6) AS phi__a, round(pb, 6) AS phi__b, round(pc, 6) AS phi__c,
round(o.a, 9) AS feature__a, round(o.b, 9) AS feature__b, round(o.c, 9) AS feature__c, round(o_totalprice, 6) AS y FROM s JOIN o USING (id) JOIN orders ON o_orderkey = s.id"""
)
def shap_plot_data(spark, sf_dir):
    sample, background = scored(spark, sf_dir)
    data = FunctionInspector(SCORE, background=background, shap_interaction=False).fit(sample, persist=False).shap_plot_data()
    return data.select("id", "output", *[F.round(f"phi__{f}", 6).alias(f"phi__{f}") for f in "abc"], *[F.round(f"feature__{f}", 9).alias(f"feature__{f}") for f in "abc"], F.round("y", 6).alias("y"))


# resampling

DRAW = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
BOOTSTRAP = f"SELECT split::INTEGER AS split, slot, {DRAW.format(chr(39) + '42:' + chr(39) + ' || split || ' + chr(39) + ':' + chr(39) + ' || slot')} % (SELECT count(*) FROM orders) AS pos FROM range(0, 5) s(split), (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS slot)"


@query(BOOTSTRAP)
def bootstrap(spark, sf_dir):
    return resample.BootstrapCV(5, 42).index(read(spark, sf_dir, "orders"), ["o_orderkey"])


@query(
    f"""WITH i AS ({BOOTSTRAP}), p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT s.split::INTEGER AS split, o_orderkey FROM p, range(0, 5) s(split) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.split = s.split AND i.pos = p.pos)"""
)
def bootstrap_oob(spark, sf_dir):
    return resample.BootstrapCV(5, 42).test(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    f"""WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), s AS (SELECT quality, n, coalesce(sum(n) OVER (ORDER BY quality ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n),
e AS (SELECT start, n, start + unnest(range(0, n)) AS slot FROM s)
SELECT split::INTEGER AS split, slot, start + {DRAW.format("'42:' || split || ':' || slot")} % n AS pos FROM e, range(0, 20) t(split)"""
)
def bootstrap_stratified(spark, sf_dir):
    return resample.StratifiedBootstrapCV(20, 42, stratum="quality").index(read(spark, sf_dir, "labels"), ["doc_id"])


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM events), s AS (SELECT split, unnest(range(0, (SELECT n FROM n))) AS slot FROM range(0, 3) t(split)),
f AS (SELECT split, slot, max(CASE WHEN slot = 0 OR {DRAW.format("'42:block:' || split || ':' || slot")} % 4503599627370496 / 4503599627370496.0::DOUBLE < 1.0::DOUBLE / 50 THEN slot END) OVER (PARTITION BY split ORDER BY slot) AS first FROM s)
SELECT split::INTEGER AS split, slot, ({DRAW.format("'42:' || split || ':' || first")} % n + slot - first) % n AS pos FROM f, n"""
)
def bootstrap_stationary(spark, sf_dir):
    return resample.StationaryBootstrapCV(3, 42, mean_block_size=50).index(read(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"])


# selection

FORMULAS = {"mean": lambda q: F.lit(38000.0), "per_unit": lambda q: 1500.0 * q, "affine": lambda q: 5000.0 + 1300.0 * q}


@query(
    """WITH l AS (SELECT c_custkey AS id, c_acctbal AS y, c_nationkey::DOUBLE AS q FROM customer),
s AS (SELECT *, (('0x' || substr(md5('0:' || id), 1, 15))::BIGINT % 5)::INTEGER AS split FROM l),
c AS (SELECT 'mean' AS candidate, split, y, 38000.0::DOUBLE AS f FROM s UNION ALL SELECT 'per_unit', split, y, 1500.0::DOUBLE * q FROM s UNION ALL SELECT 'affine', split, y, 5000.0::DOUBLE + 1300.0::DOUBLE * q FROM s),
r AS (SELECT candidate, split, -sqrt(avg(pow(y - f, 2))) AS score FROM c GROUP BY ALL),
m AS (SELECT candidate, avg(score) AS mean, stddev_pop(score) AS std FROM r GROUP BY candidate)
SELECT candidate, round(mean, 6) AS score__test__mean, round(std, 6) AS score__test__std, (rank() OVER (ORDER BY mean DESC))::INTEGER AS score__test__rank FROM m"""
)
def cv_rank_report(spark, sf_dir):
    """Candidate formulas over five folds, ranked by their mean score in one job."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").cast("double").alias("q"))
    rows = rows.withColumn("split", hash_draw(5, 0, F.col("id")).cast("int"))
    each = rows.select("split", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), f(F.col("q")).alias("f")) for n, f in FORMULAS.items()])).alias("c"))
    scores = each.groupBy("c.candidate", "split").agg((-F.sqrt(F.avg(F.pow(F.col("y") - F.col("c.f"), F.lit(2.0))))).alias("score"))
    scores = scores.withColumn("fit_s", F.lit(0.0)).withColumn("score_s", F.lit(0.0))
    report = selection.rank_report(scores.groupBy("candidate"))
    return rounded(report.select("candidate", "score__test__mean", "score__test__std", "score__test__rank"))
