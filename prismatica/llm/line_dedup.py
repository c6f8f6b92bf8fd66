"""Line deduplication with two Bloom filters.

Documents are dealt into buckets (``exchange``), so text crosses the network once.

1. A bucket tells each shard the hashes of its long line keys, once each. A
   shard passes them through a filter of hashes seen once and one of hashes seen
   twice; only hashes in the second are suspects, which go back to the buckets.
   A shard's filters are sized by what it got.
2. Only suspect lines are shuffled by their full key, one row a bucket, which
   confirms in how many documents a key really stands and which is its last.
3. Buckets drop confirmed lines except in that document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import CODE_BITS, CODE_MASK, MESSAGES, answers, bucketed, narrow, nothing, records, shard_codes, split_by_shard, table, to_shards, widen
from .textblocks import U, mix

MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_HASH = 16
PROBES = 4
SALTS = 16
BLANKS = b" \t\n\x0b\x0c\r"
RECORD = 5


class Bloom:
    """Bloom filter over 64-bit hashes."""

    def __init__(self, expected: int):
        self.bits = max(1024, BITS_PER_HASH * expected)
        self.words = np.zeros(self.bits // 64 + 1, U)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        a, b = mix(hashes, 1), mix(hashes, 2) | U(1)
        return (a[None, :] + np.arange(PROBES, dtype=U)[:, None] * b[None, :]) % U(self.bits)

    def add(self, hashes: np.ndarray) -> None:
        at = self.places(hashes).ravel()
        np.bitwise_or.at(self.words, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).astype(bool).all(axis=0)


def repeated(batches: list[np.ndarray], several: list[np.ndarray] | None = None) -> Bloom:
    """The filter of hashes seen at least twice, or marked as such."""
    total = sum(map(len, batches))
    once, twice = Bloom(total), Bloom(total)
    for i, hashes in enumerate(batches):
        distinct, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        marked = np.bincount(place, several[i], len(distinct)) > 0 if several is not None else np.zeros(len(distinct), bool)
        seen = once.has(distinct)
        twice.add(distinct[seen | (counts > 1) | marked])
        once.add(distinct[~seen])
    return twice


def line_key(line: bytes) -> bytes:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def long_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line of a text, None for keys of fewer code points."""
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars) else None for k in map(line_key, (text or "").encode().split(b"\n"))]


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _documents(group: pa.Table, min_chars: int) -> list[set[bytes]]:
    """Long keys of each document; rows that repeat id and text are one document."""
    texts = dict(zip(group.column("key").to_pylist(), group.column("text").to_pylist()))
    return [{k for k in long_keys(text, min_chars) if k is not None} for text in texts.values()]


def _ask(group: pa.Table, bucket: int, width: int, min_chars: int) -> pa.Table:
    hashes = [np.fromiter((_hash(k) for k in keys), U, len(keys)) for keys in _documents(group, min_chars)]
    codes, counts = np.unique(shard_codes(np.concatenate([np.zeros(0, U), *hashes]), width), return_counts=True)
    if not len(codes):
        return nothing()
    at, payload = split_by_shard(codes, narrow(codes & CODE_MASK | (counts > 1).astype(U) << U(CODE_BITS), RECORD))
    return table(at, np.full(len(at), bucket), np.zeros(len(at)), payload)


def _suspects(messages: pa.Table) -> pa.Table:
    """Answer each bucket with those of its codes that may stand in two documents."""
    rows, message = records(messages, RECORD)
    value = widen(rows)
    code = messages.column("shard").to_numpy().astype(U)[message] << U(CODE_BITS) | value & CODE_MASK
    step = 1 << 16
    parts = [slice(lo, lo + step) for lo in range(0, len(code), step)]
    several = value >> U(CODE_BITS) & U(1)
    twice = repeated([code[p] for p in parts], [several[p] for p in parts])
    hit = np.concatenate([np.zeros(0, np.int64), *[p.start + np.flatnonzero(twice.has(code[p])) for p in parts]])
    return answers(messages, message[hit], narrow(code[hit], 8), 0)


def _held(group: pa.Table, suspects: pa.Table, bucket: int, width: int, min_chars: int) -> pa.Table:
    """Suspect keys of a bucket: in how many documents, and the last of them."""
    found = set(np.frombuffer(b"".join(suspects.column("payload").to_pylist()), "<u8").tolist())
    held: dict[bytes, list] = {}
    if found:
        rows = dict(zip(group.column("key").to_pylist(), zip(group.column("id").to_pylist(), group.column("text").to_pylist())))
        for key, (ident, text) in rows.items():
            own = list({k for k in long_keys(text, min_chars) if k is not None})
            codes = shard_codes(np.fromiter((_hash(k) for k in own), U, len(own)), width).tolist()
            for line, code in zip(own, codes):
                if code in found:
                    seen = held.setdefault(line, [0, None, None])
                    seen[0] += 1
                    if ident is not None:
                        seen[1] = ident if seen[1] is None else max(seen[1], ident)
                    else:
                        seen[2] = key if seen[2] is None else max(seen[2], key)
    n, last, last_key = zip(*held.values()) if held else ((), (), ())
    return pa.Table.from_arrays(
        [pa.array([bucket] * len(held), pa.int64()), pa.array([k.decode() for k in held], pa.string()), pa.array(n, pa.int64()), pa.array(last, pa.int64()), pa.array(last_key, pa.int64())],
        names=["bucket", "line", "n", "last", "last_key"],
    )


OUTPUT = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])


def _drop(group: pa.Table, confirmed: pa.Table, min_chars: int) -> pa.Table:
    """The bucket's documents without confirmed lines."""
    last = {line.encode(): (ident, key) for line, ident, key in zip(*[confirmed.column(c).to_pylist() for c in ("line", "last", "last_key")])}
    out = []
    for ident, key, text in zip(*[group.column(c).to_pylist() for c in ("id", "key", "text")]):
        lines = text.split("\n")
        kept = lines
        if last:
            # an id keeps its own last lines; of documents without an id, the one with the largest key
            goes = lambda k: k in last and (last[k][0] != ident if last[k][0] is not None else last[k][1] != key)  # noqa: B023, E731
            kept = [line for line, k in zip(lines, long_keys(text, min_chars)) if k is None or not goes(k)]
        out.append((ident, len(lines), len(lines) - len(kept), text if len(kept) == len(lines) else "\n".join(kept)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUTPUT)], schema=OUTPUT)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: id, ``n_lines, n_dropped, kept_text``.

    A key of at least ``min_chars`` code points that stands in at least
    ``min_docs`` documents loses all its lines except in the largest id that
    holds it. Null or empty text is one empty line. Rows that repeat an id and
    its text count as one document and get the same result; rows that share only
    the id are documents of their own, and all keep the lines whose largest id
    it is. A row without an id counts as smaller than any id. Texts are split
    whole, whatever their length. Other columns are ignored; an empty table
    gives no rows.
    """
    rows, width = bucketed(docs, id_column, text_column)
    grouped = rows.groupBy("bucket")

    def ask(key, group):
        return _ask(group, key[0].as_py(), width, min_chars)

    def hold(key, group, suspects):
        return _held(group, suspects, key[0].as_py(), width, min_chars)

    def drop(key, group, confirmed):
        return _drop(group, confirmed, min_chars)

    suspects = to_shards(grouped.applyInArrow(ask, MESSAGES), width, _suspects)
    held = grouped.cogroup(suspects.groupBy("bucket")).applyInArrow(hold, "bucket long, line string, n long, last long, last_key long")
    confirmed = held.groupBy("line").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("last_key").alias("last_key")).filter(F.col("n") >= min_docs).drop("n")
    # a line may stand in very many buckets: its confirmation goes to SALTS places
    salted = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = held.select("bucket", "line", F.pmod("bucket", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["line", "salt"]).select("bucket", "line", "last", "last_key")
    return grouped.cogroup(told.groupBy("bucket")).applyInArrow(drop, "id long, n_lines long, n_dropped long, kept_text string").withColumnRenamed("id", id_column)


ORACLE = """
WITH l AS (
  SELECT doc_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (k.last IS NOT NULL AND k.last <> l.doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (k.last IS NULL OR k.last = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k ON l.key = k.key GROUP BY l.doc_id
"""
