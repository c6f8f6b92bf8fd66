"""Substring deduplication by fixed-block anchors.

A repeated window of ``n`` words holds a whole reference block: blocks of
``(n + 1) // 2`` words lie end to end in every document. Reference blocks are
indexed, and every rolling window of the block's length probes the index. A
rolling window that finds a block, and is found twice in all, is a hit. Hits
are extended to all windows of ``n`` words around them, which are confirmed
where their whole content (96 bits of hash) stands twice; confirmed windows
that overlap merge into maximal exact repeats.

All of it runs on the exchanges of ``exchange``: five bytes for a probe,
thirteen for a window around a hit, and text shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import CODE_MASK, MESSAGES, answers, bucketed, count_windows, narrow, nothing, records, runs, shard_codes, split_by_shard, table, to_shards, widen, window_records
from .textblocks import U, blocks, cover, windows

WINDOW = 35
PROBE_RECORD = 5


def _probes(text: pa.ChunkedArray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard codes of all rolling windows, and whether each is a reference block."""
    codes, reference = [], []
    for block in blocks(text):
        first, hashes = windows(block, size)
        codes.append(shard_codes(hashes, width))
        reference.append((first - block.word_off[block.word_doc[first]]) % size == 0)
    return (np.concatenate(codes), np.concatenate(reference)) if codes else (np.zeros(0, U), np.zeros(0, bool))


def _index(messages: pa.Table) -> pa.Table:
    """Answer the buckets with their codes that equal a reference block and stand twice."""
    rows, message = records(messages, PROBE_RECORD)
    value = widen(rows)
    shard = messages.column("shard").to_numpy().astype(U)[message]
    code = shard << U(38) | value & CODE_MASK
    several, reference = value >> U(38) & U(1), value >> U(39) & U(1)
    order = np.argsort(code, kind="stable")
    run, _ = runs(code[order])
    if not len(run):
        return nothing()
    total = np.bincount(run) + np.bincount(run, several[order])
    indexed = np.bincount(run, reference[order]) > 0
    hit = order[((total > 1) & indexed)[run]]
    return answers(messages, message[hit], narrow(code[hit], 8), 0)


def _codes(answer: pa.Table, kind: int) -> np.ndarray:
    rows = [p for k, p in zip(answer.column("kind").to_pylist(), answer.column("payload").to_pylist()) if k == kind]
    return np.unique(np.frombuffer(b"".join(rows), "<u8"))


def among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, ``n_words, n_removed, kept_text`` (kept words joined by blanks), ``spans``.

    A word goes if a window of ``window`` words that covers it starts anywhere
    else too, in any document. ``spans`` are the maximal repeats as [first, last
    + 1) pairs of word places. Null and empty texts have no words. Rows that
    repeat id and text are further places of their windows, and get equal results;
    ids may be null or shared. Texts of any length are taken whole. An empty table
    gives no rows, other columns are ignored.
    """
    rows, width = bucketed(docs, id_column, text_column)
    grouped, size = rows.groupBy("bucket"), (window + 1) // 2

    def ask(key, group):
        codes, reference = _probes(group.column("text"), size, width)
        order = np.argsort(codes, kind="stable")
        run, starts = runs(codes[order])
        if not len(run):
            return nothing()
        code = codes[order][starts]
        several = (np.bincount(run) > 1).astype(U)
        indexed = (np.bincount(run, reference[order]) > 0).astype(U)
        at, payload = split_by_shard(code, narrow(code & CODE_MASK | several << U(38) | indexed << U(39), PROBE_RECORD))
        return table(at, np.full(len(at), key[0].as_py()), np.zeros(len(at)), payload)

    def extend(key, group, hits):
        found, one, two = _codes(hits, 0), [], []
        for block in blocks(group.column("text")) if len(found) else ():
            first, hashes = windows(block, size)
            at = first[among(shard_codes(hashes, width), found)]
            near = cover(len(block.words[0]) + size, at, size)[size - 1 :]  # starts within size - 1 words before a hit
            first, hashes = windows(block, window)
            some = near[first]
            one.append(hashes[some])
            two.append(windows(block, window, 1)[1][some])
        if not one or not sum(map(len, one)):
            return nothing()
        at, payload = window_records(np.concatenate(one), np.concatenate(two), width)
        return table(at, np.full(len(at), key[0].as_py()), np.zeros(len(at)), payload)

    output = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.int64()))])

    def finish(key, group, repeats):
        found, out = _codes(repeats, 0), []
        ids = group.column("id").to_pylist()
        for block in blocks(group.column("text")):
            total = len(block.words[0])
            gone = np.zeros(total, bool)
            if len(found):
                first, hashes = windows(block, window, 1)
                gone = cover(total, first[among(hashes, found)], window)
            # keep the bytes of kept words, and one blank after each
            starts, ends = block.words
            for i in range(block.n):
                a, b = block.word_off[i], block.word_off[i + 1]
                own = gone[a:b]
                text = block.text(i)
                words = text.split()
                edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
                if own.any():
                    words = [w for w, g in zip(words, own.tolist()) if not g]
                out.append((ids[block.lo + i], b - a, int(own.sum()), b" ".join(words).decode(), edges.tolist()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), output)], schema=output)

    hits = to_shards(grouped.applyInArrow(ask, MESSAGES), width, _index)
    candidates = grouped.cogroup(hits.groupBy("bucket")).applyInArrow(extend, MESSAGES)
    repeats = to_shards(candidates, width, lambda messages: count_windows(messages, 0))
    return (
        grouped.cogroup(repeats.groupBy("bucket"))
        .applyInArrow(finish, "id long, n_words long, n_removed long, kept_text string, spans array<bigint>")
        .withColumnRenamed("id", id_column)
    )


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS place, unnest(list_transform(range(1, len(words) - 33), lambda i: md5(array_to_string(words[i:i + 34], ' ')))) AS content FROM d WHERE len(words) >= 35),
r AS (SELECT doc_id, place FROM w WHERE content IN (SELECT content FROM w GROUP BY content HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, place + unnest(range(0, 35)) AS place FROM r),
l AS (SELECT doc_id, list(place) AS gone FROM g GROUP BY doc_id),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.place) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.place = t.place WHERE g.place IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""
