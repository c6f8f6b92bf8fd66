import random
from collections import Counter

import numpy as np
import pytest

from prismatica.llm import column_bwt, suffix_dedup


def test_transform_and_prefixes_equal_sorting():
    rng = random.Random(3)
    for _ in range(30):
        strings = [bytes(rng.choices(b"abc", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        data, off = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
        bwt, lcp = column_bwt.build(data, off)
        suffixes = sorted(((s[i:], -1, k, s[i - 1] + 1 if i else 0) for k, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: (list(x[0]) + [-1], x[2]))
        assert bwt.tolist() == [s[3] for s in suffixes]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp.tolist()[1:] == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]


def brute(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (ident, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((ident, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, bucket int, key string")
    got = suffix_dedup.dedup_bytes(docs, **options).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=repr) == brute(rows, options.get("window", 200))


def test_equals_brute_force_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_rows_of_one_id_and_long_texts(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choices("abcdefgh é\n", k=k))
    shared, long = word(400), word(1_200_000)
    check(spark, [(1, word(50) + shared), (1, shared + word(70)), (1, "short"), (2, "x" + shared[100:]), (2, "x" + shared[100:]), (None, shared[:250]), (None, shared[5:])])
    docs = spark.createDataFrame([(1, long), (2, "y" * 10 + long[600_000:600_300]), (3, long[:150])], "doc_id long, text string")
    at = len(long[:600_000].encode())
    size = len(long[600_000:600_300].encode())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(docs).collect()}
    whole = long.encode()
    assert got == {1: (len(whole), size, 1, whole[:at] + whole[at + size :]), 2: (10 + size, size, 1, b"y" * 10), 3: (len(long[:150].encode()), 0, 0, long[:150].encode())}


def test_awkward_rows(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choices("abcdé", k=k))
    shared = [word(60) for _ in range(4)]
    rows = [(i * 7, word(rng.randint(0, 40)) + rng.choice(shared) + word(rng.randint(0, 40))) for i in range(300)]
    rows += [(-5, None), (-6, ""), (None, word(20) + shared[0]), (10**9, "a" * 300), (10**9 + 1, "a" * 500), (7, rows[1][1]), (10**10, "ab" * 200)]
    check(spark, rows, window=30, anchor=15)
    assert suffix_dedup.dedup_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bucket, collection", [(1, 4096), (16, 2)])
def test_crowded_anchors_are_counted(spark, monkeypatch, bucket, collection):
    # workers get the functions of this module by name, so limits are tried on the steps themselves
    monkeypatch.setattr(suffix_dedup, "BUCKET_SEGMENTS", bucket)
    monkeypatch.setattr(suffix_dedup, "COLLECTION_SEGMENTS", collection)
    import pyarrow as pa

    rng = random.Random(9)
    word = lambda k: "".join(rng.choices("abcd", k=k))
    passage = word(50)
    rows = [(i, word(rng.randint(0, 30)) + passage + word(rng.randint(0, 30))) for i in range(40)] + [(50, passage + "zz"), (51, "q" + passage)]
    groups = {b: pa.table({"id": [i for i, _ in part], "key": [i for i, _ in part], "text": [t for _, t in part]}) for b in (0, 1) for part in [[r for r in rows if r[0] % 2 == b]]}
    deal = lambda tables, step: step(pa.concat_tables(tables))
    of = lambda t, b: t.filter(pa.compute.equal(t.column("bucket"), b))
    told = deal([suffix_dedup._ask(g, b, 3, 30, 15) for b, g in groups.items()], suffix_dedup._compare)
    sent = [suffix_dedup._send(g, of(told, b), b, 3, 30, 15) for b, g in groups.items()]
    assert any(suffix_dedup.COUNTED in t.column("kind").to_pylist() for t in sent)
    found = deal(sent, lambda t: suffix_dedup._index(t, 30, 15))
    got = [tuple(r.values()) for b, g in groups.items() for r in suffix_dedup._cut(g, of(found, b), 30).to_pylist()]
    assert sorted(got, key=repr) == brute(rows, 30)
