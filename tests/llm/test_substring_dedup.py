import re
from collections import Counter

from pyspark.sql import functions as F

from prismatica.llm import substring_dedup


def brute(rows, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (ident, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((ident, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def check(spark, rows, n):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, bucket int, key string")
    got = substring_dedup.dedup_substrings(docs, window=n).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=repr) == brute(rows, n)


def test_equals_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], 35)


def test_awkward_rows(spark):
    a = "a b c d e f g h"
    check(spark, [(1, None), (2, ""), (3, a), (None, a + " x"), (5, "x x x x x x x x x"), (5, "x x x x x x x x x"), (-7, " \n\t" + a.replace(" ", "\x0b")), (900, "b c d e f"), (901, "é ü  b c d e f g")], 5)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup_substrings(docs).count() == 0


def test_a_text_of_many_blocks_and_rows_of_one_id(spark):
    import random

    rng = random.Random(3)
    long = rng.choices([f"wort{i}" for i in range(400)], k=600_000)
    rows = [(1, " ".join(long)), (2, "x " + " ".join(long[300_000:300_050])), (2, " ".join(long[10:60])), (2, "other"), (None, " ".join(long[20:70])), (3, "é" * 3_000_000), (4, " ".join(long[599_970:]))]
    check(spark, rows, 35)
