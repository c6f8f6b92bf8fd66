import glob
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prismatica.llm import near_dedup as nd
from prismatica.llm.common import Scratch
from prismatica.llm.textblocks import blocks


def sets(texts):
    block = next(blocks(pa.array(texts), 1 << 30))
    doc, element, weight = nd.elements(block)
    return block, doc, element, weight


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    agree, true = [], []
    for _ in range(60):
        a = {k: rng.randint(1, 9) for k in range(40)}
        b = {k: (v if rng.random() < 0.8 else rng.randint(1, 9)) for k, v in a.items()} | {99: 3}
        doc = np.array([0] * len(a) + [1] * len(b))
        element = np.array([*a, *b], np.uint64)
        weight = np.array([*a.values(), *b.values()])
        s = nd.signatures(doc, nd.mix(element), weight, 2)
        agree.append((s[0] == s[1]).mean())
        true.append(sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}))
    assert abs(np.mean(agree) - np.mean(true)) < 0.02


def brute(rows, similarity=0.8):
    """Union of all pairs that are similar enough, and of equal word sequences."""
    words = [(t or "").split() for _, t in rows]
    from collections import Counter

    bags = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter() for w in words]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            if bags[i] and common and common >= similarity * sum((bags[i] | bags[j]).values()):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (ident, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(ident)
    return {ident: min(g) for g in groups.values() for ident in g}


def test_classes_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 200))
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "one two"), (1004, "one two"), (1005, "one three"), (1006, "x " * 300), (1007, "x " * 310)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, node int")
    got = nd.near_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert nd.near_classes(docs.limit(0)).count() == 0
    assert sorted(nd.drop_near(docs).columns) == sorted(docs.columns)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()} == brute(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 130)]
    links = spark.createDataFrame([(1, 2), (3, 4), (2, 3), (9, 10), (8, 9), (7, 8), (20, 30), (20, 30), *[(500, i) for i in range(501, 520)], *[(i, 999) for i in range(900, 920)], *chain], "a long, b long")
    with Scratch(spark, "test") as scratch:
        found = dict(map(tuple, nd.components(links, scratch).collect()))
        assert nd.components(links.limit(0), scratch).count() == 0
    groups = [{1, 2, 3, 4}, {7, 8, 9, 10}, {20, 30}, {*range(500, 520)}, {*range(900, 920), 999}, {*range(100, 131)}]
    for group in groups:
        assert len({found.get(n, n) for n in group}) == 1
    assert len({found.get(n, n) for g in groups for n in g}) == len(groups) and len(found) == sum(len(g) - 1 for g in groups)
    assert not glob.glob(f"{scratch.folder}*")


def linked(spark, members, texts):
    members = spark.createDataFrame(members, "hash long, node long")
    texts = spark.createDataFrame(texts, "node long, text string")
    with Scratch(spark, "test") as scratch:
        return {r.node: r["class"] for r in nd._linked(members, texts, 0.8, scratch).collect()}


def test_ties_are_compared(spark):
    # of ten windows, two texts lack a different fifth each: 0.8 to the third text, 0.6 to one another
    words = [f"w{i}" for i in range(14)]
    for order in ((1, 2, 3), (3, 2, 1), (2, 3, 1)):
        texts = [" ".join(words[:12]), " ".join(words[2:]), " ".join(words)]
        assert len(set(linked(spark, [(1, n) for n in order], list(zip(order, texts))).values())) == 1


def test_one_group_over_many_blocks(spark, monkeypatch):
    # a soft cloud of copies in one group, whose links don't all go through one leader
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 7)
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(90)], []
    for n in range(120):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            text[rng.randrange(90)] = f"x{rng.randrange(40)}"
        rows.append((n, " ".join(text)))
    rows = [(n, t) for n, t in rows if t not in {u for m, u in rows if m < n}]
    got = linked(spark, [(5, n) for n, _ in rows], rows)
    want = brute(rows)
    assert len(set(want.values())) > 5
    assert {n: min(m for m in got if got[m] == got[n]) for n in got} == want


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " end"
    rows = [(None, text, 1), (None, text, 2), (5, near, 3), (5, near, 4), (5, "something else", 5), (None, "alone", 6), (None, "alone", 7), (9, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in nd.near_classes(docs).collect()), key=str)
    assert got == sorted([(None, 5, False)] * 2 + [(5, 5, True)] * 3 + [(None, None, True)] * 2 + [(9, 9, True)], key=str)
    assert sorted(((r.doc_id, r.text) for r in nd.drop_near(docs).collect()), key=str) == sorted([(5, near), (5, "something else"), (None, "alone"), (9, None)], key=str)
    assert nd.drop_near(docs.limit(0)).count() == 0 and nd.drop_near(docs).columns == docs.columns


def test_a_text_of_many_blocks(spark):
    rng = random.Random(5)
    long = " ".join(rng.choices([f"word{i}" for i in range(3000)], k=500_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
