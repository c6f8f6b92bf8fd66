"""Compact exchanges between documents and shards of hashes.

Documents are dealt into buckets. A bucket tells each shard
which hashes it holds, once each (so what one key can send to its shard is
bounded by the number of buckets, not by its copies), in a few bytes a hash. A
shard finds what is repeated and answers the buckets. Text crosses the network
once, to its bucket; that shuffle is the same in every step, so Spark reuses it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, shuffle_width
from .textblocks import U

#: Documents of a bucket, on average.
BUCKET = 64
#: Documents whose hashes a shard holds, at most on average.
SHARD = 1 << 16
CODE_BITS = 38
CODE_MASK = U((1 << CODE_BITS) - 1)
MESSAGES = "shard int, bucket long, kind int, payload binary"


def bucketed(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """``(bucket, id, key, text)``, and the number of shards.

    Rows are dealt by their key, however sparse or equal ids are. There are as
    many shards as shuffle partitions, and more if those were too few for the
    rows: a shard's messages are held by one Python worker.
    """
    rows = keyed(docs, id_column, text_column)
    n = rows.count()
    width = max(shuffle_width(docs.sparkSession), -(-n // SHARD))
    return rows.select(F.pmod("key", F.lit(max(width, -(-n // BUCKET)))).alias("bucket"), "id", "key", "text"), width


def to_shards(messages: DataFrame, width: int, step: Callable) -> DataFrame:
    """Deal messages to their shards and run ``step`` on all messages of a task at once.

    ``step(table)`` gets columns ``shard, bucket, kind, payload`` and gives rows of the same kind.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from step(pa.Table.from_batches(held)).to_batches(max_chunksize=256)

    return messages.repartitionById(width, F.col("shard")).mapInArrow(run, MESSAGES)


def table(shard, bucket, kind, payload) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array(np.asarray(shard), pa.int32()), pa.array(np.asarray(bucket), pa.int64()), pa.array(np.asarray(kind), pa.int32()), pa.array(payload, pa.binary())],
        names=["shard", "bucket", "kind", "payload"],
    )


def nothing() -> pa.Table:
    return table([], [], [], [])


def shard_codes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Shard number above CODE_BITS bits of the hash."""
    return ((hashes >> U(CODE_BITS)) % U(width)) << U(CODE_BITS) | hashes & CODE_MASK


def split_by_shard(codes: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Records (rows of bytes) of sorted codes, joined by shard."""
    shard = (codes >> U(CODE_BITS)).astype(np.int64)
    bounds = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(0, np.int64)
    return shard[bounds[:-1]] if len(bounds) else shard, [records[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def narrow(values: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of 64-bit integers, as rows."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :size]


def widen(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(U).ravel()


def records(messages: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All payload records as rows of bytes, and the message of each."""
    bodies, counts = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for chunk in messages.column("payload").chunks:
        _, offsets, data = chunk.buffers()
        off = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if offsets is not None and len(chunk) else np.zeros(1, np.int32)
        if data is not None:
            bodies.append(np.frombuffer(data, np.uint8)[off[0] : off[-1]])
        counts.append(np.diff(off).astype(np.int64) // size)
    counts = np.concatenate(counts)
    return np.concatenate(bodies).reshape(-1, size), np.repeat(np.arange(len(counts)), counts)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run number of each element, and the first element of each run."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def answers(messages: pa.Table, message: np.ndarray, rows: np.ndarray, kind: int) -> pa.Table:
    """Rows of bytes sent back to the buckets that their messages came from."""
    bucket = messages.column("bucket").to_numpy()[message]
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    bounds = np.append(runs(bucket)[1], len(bucket))
    return table(np.zeros(max(len(bounds) - 1, 0)), bucket[bounds[:-1]] if len(bucket) else [], np.full(max(len(bounds) - 1, 0), kind), [rows[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])])


# windows told apart by 96 bits: counted where they meet

WINDOW_RECORD = 13


def window_records(first: np.ndarray, second: np.ndarray, width: int) -> tuple[np.ndarray, list[bytes]]:
    """Distinct windows of a bucket as records: 64 + 32 bits and whether there are several."""
    order = np.argsort(second, kind="stable")
    run, starts = runs(second[order])
    several = np.bincount(run, minlength=len(starts)) > 1
    some = order[starts]
    shard = (first[some] >> U(32)) % U(width)
    by = np.argsort(shard, kind="stable")
    some, several, shard = some[by], several[by], shard[by]
    rows = np.concatenate([narrow(second[some], 8), narrow(first[some], 4), several.astype(np.uint8)[:, None]], axis=1)
    return split_by_shard(shard << U(CODE_BITS), rows)


def count_windows(messages: pa.Table, kind: int) -> pa.Table:
    """Answer each bucket with those of its windows (64 bits each) that are found twice or more."""
    rows, message = records(messages, WINDOW_RECORD)
    second, first, several = widen(rows[:, :8]), widen(rows[:, 8:12]), rows[:, 12] > 0
    order = np.lexsort((first, second))
    same = np.zeros(len(order), bool)
    a, b = second[order], first[order]
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    run = np.cumsum(~same) - 1
    total = np.bincount(run) + np.bincount(run, several[order]) if len(run) else run
    hit = order[total[run] > 1] if len(run) else order
    return answers(messages, message[hit], rows[hit, :8], kind)
