import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_near_dedup import brute

import corpus_pipeline
from prismatica.llm import byte_bpe, mixing, quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, sf01, tmp_path_factory):
    """Documents with repeated rows, missing values and columns whose names clash, and their labels."""
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf01}/documents.parquet").filter("doc_id < 350")
    more = docs.filter("doc_id % 60 = 1").selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' ') AS text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(200000, None, "en", "s", 0), (200001, "", "en", None, 0)], docs.schema)
    rows = docs.union(more).union(docs.filter("doc_id = 7")).union(docs.filter("doc_id = 9").selectExpr("doc_id", "text", "lang", "NULL AS source", "n_chars")).union(odd)
    rows.selectExpr("*", "1 AS row_key", "2 AS taken", "3 AS node", "'x' AS ids").write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{sf01}/labels.parquet").write.parquet(str(path / "labels.parquet"))
    return str(path)


def plain(df):
    return sorted((tuple(r[c] for c in df.columns) for r in df.collect()), key=repr)


def test_stages_equal_brute_force(spark, folder):
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        if name != "byte_bpe":
            assert spark.read.parquet(path).columns == docs.columns
        docs = after[name] = spark.read.parquet(path)
    before = spark.read.parquet(f"{folder}/documents.parquet")

    model = quality.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {(r.doc_id, r.n_words) for r in quality.judge(before, model).collect() if r.kept}
    words = lambda t: len([w for w in SPACE.split(t or "") if w])
    assert plain(after["quality_rules"]) == sorted((tuple(r) for r in before.collect() if (r.doc_id, words(r.text)) in good), key=repr)

    least = {}
    for r in after["quality_rules"].collect():
        key = SPACE.sub(" ", r.text)
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    kept = after["exact_dedup"].collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values()) and len(kept) < after["quality_rules"].count()

    rows = [(r.doc_id, r.text) for r in kept]
    classes = brute(rows)
    assert sorted(r.doc_id for r in after["near_dedup"].collect()) == sorted(set(classes.values())) and len(set(classes.values())) < len(rows)

    documents = after["near_dedup"].toPandas()  # noqa: F841
    repeats = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, repeats FROM ({mixing.ORACLE})").fetchall()}
    found = {}
    for r in after["mixing"].collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: v for k, v in repeats.items() if v}

    data = open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb").read()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(data), special_tokens={})
    texts = {r.doc_id: r.text for r in after["mixing"].collect()}
    coded = after["byte_bpe"].collect()
    assert len(coded) == after["mixing"].count()
    for r in coded:
        assert list(memoryview(bytes(r.ids)).cast("I")) == own.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()
    assert plain(corpus_pipeline.run(spark, folder)) == plain(after["byte_bpe"])


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
