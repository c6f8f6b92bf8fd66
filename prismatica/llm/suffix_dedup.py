"""Removal of repeated byte strings by a suffix structure built column by column.

Windows of ``n`` bytes that are equal have the same anchor: of the strings of
``ANCHOR`` bytes inside the first whose leading bytes have the least hash. Neighbouring windows with one
anchor form a segment, about a fiftieth of the bytes in number. Shards compare
anchors (38 bits) and segment contents (64 bits):

* segments whose whole content stands twice are repeats throughout,
* other segments that share an anchor go to the anchor's shard with their
  bytes. Those that share a longer string around the anchor, as any two with a
  common window do, are indexed in collections of bounded size by ``column_bwt``;
  common prefixes of ``n`` bytes or more are repeats,
* anchors shared by very many different segments would make one collection too
  large; their windows are counted one by one (96 bits of hash) over all shards.

Buckets then cut all bytes that a repeated window covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from .column_bwt import repeated_windows
from .exchange import CODE_MASK, MESSAGES, answers, bucketed, count_windows, narrow, nothing, records, runs, shard_codes, split_by_shard, table, to_shards, widen, window_records
from .substring_dedup import among
from .textblocks import FAMILIES, U, Block, blocks, cover, mix, ranges

WINDOW = 200
ANCHOR = 100
#: Different segments of an anchor that one bucket reports, and that one collection takes.
BUCKET_SEGMENTS = 16
COLLECTION_SEGMENTS = 1024
COLLECTION_BYTES = 1 << 17
#: Places by which the strings that are tried around anchors differ.
STEP = 4
#: Bytes of a block: numbers of its places stay in cache.
BLOCK = (1 << 18) - 64

WHOLE, OWN, REFERENCE, HOT = 1, 2, 3, 4
SPANS, PENDING, CONTENT, COUNTED = 0, 1, 2, 3
ASK_RECORD, ANSWER_RECORD, SPAN_RECORD, HEAD_RECORD = 13, 17, 16, 25


class Segments:
    """Segments of a block: first window, number of windows, the anchor's place, hashes of anchor and content."""

    def __init__(self, block: Block, n: int, anchor: int):
        self.block, self.n = block, n
        sizes = np.maximum(np.diff(block.off) - n + 1, 0)
        starts = ranges(block.off[:-1], sizes)
        if not len(starts):
            self.first = self.size = self.doc = self.place = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, U)
            return
        place = _first_least(_order(block.data, len(block.data) - anchor + 1), n - anchor + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        self.first, self.size, self.place = starts[at], np.diff(np.append(at, len(starts))), place[at]
        self.doc = np.searchsorted(block.off, self.first, "right") - 1
        text = block.data.tobytes()
        self.anchor = _hashes(text, self.place, self.place + anchor)
        self.content = _hashes(text, self.first, self.first + self.size - 1 + n)


def _order(data: np.ndarray, n: int) -> np.ndarray:
    """A pseudo-random number of the (up to) eight bytes at each of the first ``n`` places: the order of anchors."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(padded), U)
    for i in range(8):
        some = padded[i : i + (len(padded) - i) // 8 * 8].view(U)
        out[i : i + 8 * len(some) : 8] = some
    out = out[:n] * U(0x9E3779B97F4A7C15)
    out ^= out >> U(32)
    out *= U(0xD6E8FEB86659FD93)
    return out


def _hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.fromiter((xxh3_64_intdigest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), U, len(starts))


def _first_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of each window of ``width`` values."""
    # the hash's high bits above the place, which settles ties
    bits = max(int(len(hashes)).bit_length(), 1)
    packed = hashes >> U(bits) << U(bits) | np.arange(len(hashes), dtype=U)
    blocks_ = -(-len(packed) // width) + 1
    padded = np.full(blocks_ * width, np.iinfo(np.uint64).max, U)
    padded[: len(packed)] = packed
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(len(packed))
    least = np.minimum(backward[at], forward[np.minimum(at + width - 1, len(padded) - 1)])
    return (least & U((1 << bits) - 1)).astype(np.int64)


def _ask(group: pa.Table, bucket: int, width: int, n: int, anchor: int) -> pa.Table:
    parts = [Segments(b, n, anchor) for b in blocks(group.column("text"), BLOCK)]
    code = shard_codes(np.concatenate([p.anchor for p in parts]), width)
    content = np.concatenate([p.content for p in parts])
    if not len(code):
        return nothing()
    order = np.lexsort((content, code))
    code, content = code[order], content[order]
    same = np.zeros(len(order), bool)
    same[1:] = (code[1:] == code[:-1]) & (content[1:] == content[:-1])
    run, first = np.cumsum(~same) - 1, np.flatnonzero(~same)
    several = np.bincount(run) > 1
    code, content = code[first], content[first]
    by_code, starts = runs(code)
    crowded = np.bincount(by_code)[by_code] > BUCKET_SEGMENTS
    lead = np.zeros(len(code), bool)
    lead[starts] = True
    keep = ~crowded | lead
    value = code & CODE_MASK | several.astype(U) << U(38) | crowded.astype(U) << U(39)
    at, payload = split_by_shard(code[keep], np.concatenate([narrow(value[keep], 5), narrow(content[keep], 8)], axis=1))
    return table(at, np.full(len(at), bucket), np.zeros(len(at)), payload)


def _compare(messages: pa.Table) -> pa.Table:
    """Tell buckets what holds for their segments: code, content and one of WHOLE, OWN, REFERENCE, HOT."""
    rows, message = records(messages, ASK_RECORD)
    if not len(rows):
        return nothing()
    value, content = widen(rows[:, :5]), widen(rows[:, 5:13])
    code = messages.column("shard").to_numpy().astype(U)[message] << U(38) | value & CODE_MASK
    order = np.lexsort((content, code))
    code, content, value, message = code[order], content[order], value[order], message[order]
    several, crowded = value >> U(38) & U(1), value >> U(39) & U(1)
    by_code, _ = runs(code)
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (content[1:] != content[:-1])
    run = np.cumsum(new) - 1
    entries = (np.bincount(run) + np.bincount(run, several))[run]
    variants = np.bincount(by_code, new)[by_code]
    hot = (np.bincount(by_code, crowded)[by_code] > 0) | (variants > COLLECTION_SEGMENTS)
    state = np.where(entries > 1, np.where((variants > 1) & new, REFERENCE, WHOLE), np.where(variants > 1, OWN, 0))
    state[hot] = HOT
    told = state > 0
    # one answer on a hot anchor is enough for a bucket
    rows = np.concatenate([narrow(code, 8), narrow(content, 8), state.astype(np.uint8)[:, None]], axis=1)
    return answers(messages, message[told], rows[told], 0)


def _send(group: pa.Table, answer: pa.Table, bucket: int, width: int, n: int, anchor: int) -> pa.Table:
    rows = np.frombuffer(b"".join(answer.column("payload").to_pylist()), np.uint8).reshape(-1, ANSWER_RECORD)
    if not len(rows):
        return nothing()
    code, content, state = widen(rows[:, :8]), widen(rows[:, 8:16]), rows[:, 16]
    hot = np.unique(code[state == HOT])
    pick = state != HOT
    told = mix(code[pick] ^ mix(content[pick], 3))
    order = np.argsort(told)
    told, told_state = told[order], state[pick][order]
    keys = group.column("key").to_numpy()
    spans, pending, heads, bodies, codes, one, two = [], [], [], [], [], [], []
    shipped: set[int] = set()
    for block in blocks(group.column("text"), BLOCK):
        seg = Segments(block, n, anchor)
        own = shard_codes(seg.anchor, width)
        is_hot = among(own, hot)
        label = mix(own ^ mix(seg.content, 3))
        found = among(label, told) & ~is_hot
        kind = np.zeros(len(own), np.int64)
        if len(told):
            kind[found] = told_state[np.searchsorted(told, label[found])]
        key, start = keys[block.lo + seg.doc], seg.first - block.off[seg.doc]
        record = lambda where: np.concatenate([narrow(key[where].astype(np.int64), 8), narrow(start[where], 4), narrow(seg.size[where], 4)], axis=1)  # noqa: B023, E731
        spans.append(record((kind == WHOLE) | (kind == REFERENCE)))
        pending.append(record(is_hot))
        for i in np.flatnonzero((kind == OWN) | (kind == REFERENCE)).tolist():
            if kind[i] == REFERENCE and int(label[i]) in shipped:
                continue
            shipped.add(int(label[i]))
            body = block.data[seg.first[i] : seg.first[i] + seg.size[i] - 1 + n]
            heads.append((int(own[i]), int(key[i]), int(start[i]), len(body), int(seg.place[i] - seg.first[i]), kind[i] == OWN))
            bodies.append(body.tobytes())
            codes.append(int(own[i]))
        if is_hot.any():
            at = ranges(seg.first[is_hot], seg.size[is_hot])
            one.append(FAMILIES[0].spans(block.prefix(0), at, at + n))
            two.append(FAMILIES[1].spans(block.prefix(1), at, at + n))
    out = [
        table([bucket % width], [bucket], [kind], [b"".join(p.tobytes() for p in part)])
        for kind, part in ((SPANS, spans), (PENDING, pending))
        if sum(map(len, part))
    ]
    if codes:
        order = np.argsort(np.array(codes, U), kind="stable")
        shard = (np.array(codes, U)[order] >> U(38)).astype(np.int64)
        bounds = np.append(runs(shard)[1], len(shard))
        head = np.array(heads, HEAD)[order]
        payload = [len(head[a:b]).to_bytes(4, "little") + head[a:b].tobytes() + b"".join([bodies[i] for i in order[a:b].tolist()]) for a, b in zip(bounds[:-1], bounds[1:])]
        out.append(table(shard[bounds[:-1]], np.full(len(payload), bucket), np.full(len(payload), CONTENT), payload))
    if one:
        at, payload = window_records(np.concatenate(one), np.concatenate(two), width)
        out.append(table(at, np.full(len(at), bucket), np.full(len(at), COUNTED), payload))
    return pa.concat_tables(out) if out else nothing()


HEAD = np.dtype([("code", "<u8"), ("key", "<i8"), ("start", "<i4"), ("size", "<i4"), ("anchor", "<i4"), ("own", "u1")])


def _promising(head: np.ndarray, begin: np.ndarray, text: bytes, n: int, anchor: int) -> np.ndarray:
    """Segments that may share a window with another of their anchor.

    A shared window reaches L bytes to the left of the anchor and n - anchor - L
    to the right. Rounded down to a multiple of STEP, L gives a string around the
    anchor that both segments have; its hash must stand twice.
    """
    more, seen, own = n - anchor, {}, []
    for code, size, place, lo in zip(head["code"].tolist(), head["size"].tolist(), head["anchor"].tolist(), begin.tolist()):
        around = []
        for left in range(0, more + 1, STEP):
            first, last = place - left, place + anchor + max(0, more - left - STEP + 1)
            if first >= 0 and last <= size:
                around.append((code, left, xxh3_64_intdigest(text[lo + first : lo + last])))
        for key in around:
            seen[key] = seen.get(key, 0) + 1
        own.append(around)
    return np.fromiter((any(seen[key] > 1 for key in around) for around in own), bool, len(own))


def _index(messages: pa.Table, n: int, anchor: int) -> pa.Table:
    kinds = messages.column("kind").to_numpy()
    take = lambda kind: messages.take(pa.array(np.flatnonzero(kinds == kind)))
    out = [take(SPANS), take(PENDING), count_windows(take(COUNTED), COUNTED)]
    content = take(CONTENT)
    heads, bodies, bucket = [], [], []
    for payload, b in zip(content.column("payload").to_pylist(), content.column("bucket").to_pylist()):
        count = int.from_bytes(payload[:4], "little")
        head = np.frombuffer(payload, HEAD, count, 4)
        heads.append(head)
        bucket.append(np.full(count, b))
        bodies.append(np.frombuffer(payload, np.uint8, offset=4 + count * HEAD.itemsize))
    if heads:
        head, data, bucket = np.concatenate(heads), np.concatenate(bodies), np.concatenate(bucket)
        size = head["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(head["code"], kind="stable")
        order = order[_promising(head, begin, data.tobytes(), n, anchor)[order]]
        _, starts = runs(head["code"][order])
        bounds = np.append(starts, len(order)) if len(order) else np.zeros(1, np.int64)
        spans, whose, lo = [], [], 0
        upto = np.append(0, np.cumsum(size[order]))
        while lo < len(bounds) - 1:
            # whole anchors, as many as a collection takes
            hi = max(lo + 1, int(np.searchsorted(upto[bounds], upto[bounds[lo]] + COLLECTION_BYTES, "right")) - 1)
            some = order[bounds[lo] : bounds[hi]]
            lo = hi
            off = np.append(0, np.cumsum(size[some]))
            hit = repeated_windows(data[ranges(begin[some], size[some])], off, n)
            hit &= np.repeat(head["own"][some] > 0, size[some])
            edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
            # runs of hits never cross segments: a segment's last n - 1 places are no windows
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            owner = some[np.searchsorted(off, first, "right") - 1]
            start = head["start"][owner] + first - off[np.searchsorted(off, first, "right") - 1]
            spans.append(np.concatenate([narrow(head["key"][owner], 8), narrow(start.astype(np.int64), 4), narrow(last - first, 4)], axis=1))
            whose.append(bucket[owner])
        rows, whose = np.concatenate([np.zeros((0, SPAN_RECORD), np.uint8), *spans]), np.concatenate([np.zeros(0, np.int64), *whose])
        order = np.argsort(whose, kind="stable")
        rows, whose = rows[order], whose[order]
        bounds = np.append(runs(whose)[1], len(whose))
        out.append(table(np.zeros(len(bounds) - 1), whose[bounds[:-1]] if len(whose) else [], np.full(len(bounds) - 1, SPANS), [rows[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]))
    return pa.concat_tables(out)


OUTPUT = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(group: pa.Table, answer: pa.Table, n: int) -> pa.Table:
    kinds, payloads = answer.column("kind").to_pylist(), answer.column("payload").to_pylist()
    rows = {k: np.frombuffer(b"".join([p for q, p in zip(kinds, payloads) if q == k]), np.uint8).reshape(-1, 8 if k == COUNTED else SPAN_RECORD) for k in (SPANS, PENDING, COUNTED)}
    counted = np.unique(widen(rows[COUNTED]))
    by_key = {}
    for k in (SPANS, PENDING):
        key, start, size = widen(rows[k][:, :8]).view(np.int64), widen(rows[k][:, 8:12]).view(np.int64), widen(rows[k][:, 12:16]).view(np.int64)
        order = np.argsort(key, kind="stable")
        by_key[k] = key[order], start[order], size[order]
    ids, keys = group.column("id").to_pylist(), group.column("key").to_pylist()
    out = []
    for block in blocks(group.column("text")):
        for i in range(block.n):
            text = block.data[block.off[i] : block.off[i + 1]]
            own = {}
            for k in (SPANS, PENDING):
                a, b = np.searchsorted(by_key[k][0], [keys[block.lo + i]] * 2, "left")[0], np.searchsorted(by_key[k][0], keys[block.lo + i], "right")
                own[k] = by_key[k][1][a:b], by_key[k][2][a:b]
            start, size = own[SPANS]
            if len(own[PENDING][0]) and len(counted):
                at = ranges(*own[PENDING])
                hit = at[among(FAMILIES[1].spans(FAMILIES[1].prefix(text), at, at + n), counted)]
                start, size = np.append(start, hit), np.append(size, np.ones(len(hit), np.int64))
            if not len(start):
                out.append((ids[block.lo + i], len(text), 0, 0, text.tobytes()))
                continue
            gone = cover(len(text), start, size + n - 1)
            edges = np.diff(gone.astype(np.int8), prepend=0)
            out.append((ids[block.lo + i], len(text), int(gone.sum()), int((edges == 1).sum()), text[~gone].tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: id, ``n_bytes, n_removed, n_spans, kept`` (remaining bytes).

    A byte goes if a string of ``window`` bytes that covers it starts anywhere
    else too, in any document; the input decides, not what is left. Null is
    empty. Rows that repeat id and text are further places of their strings, and
    get equal results; ids may be null or shared. Texts of any length are taken
    whole. Other columns are ignored; an empty table gives no rows.
    """
    rows, width = bucketed(docs, id_column, text_column)
    grouped = rows.groupBy("bucket")

    def ask(key, group):
        return _ask(group, key[0].as_py(), width, window, anchor)

    def send(key, group, answer):
        return _send(group, answer, key[0].as_py(), width, window, anchor)

    def finish(key, group, answer):
        return _cut(group, answer, window)

    compared = to_shards(grouped.applyInArrow(ask, MESSAGES), width, _compare)
    sent = grouped.cogroup(compared.groupBy("bucket")).applyInArrow(send, MESSAGES)
    indexed = to_shards(sent, width, lambda messages: _index(messages, window, anchor))
    return grouped.cogroup(indexed.groupBy("bucket")).applyInArrow(finish, OUTPUT).withColumnRenamed("id", id_column)


#: Strings as hexadecimal digits, cut into pieces so that each is read from near its place.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
b AS (SELECT doc_id, digits, (length(digits) // 2)::BIGINT AS n FROM d),
p AS (SELECT doc_id, n, piece, substr(digits, 2 * piece + 1, 2398) AS own FROM (SELECT *, unnest(range(0, greatest(n - 199, 0), 1000)) AS piece FROM b)),
i AS (SELECT doc_id, piece, own, unnest(range(0, least(1000, n - 199 - piece))) AS i FROM p),
w AS (SELECT doc_id, piece + i AS place, md5_number(substr(own, (2 * i + 1)::BIGINT, 400)) AS content FROM i),
r AS (SELECT doc_id, place, place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) <= 200 AS joined FROM w WHERE content IN (SELECT content FROM w GROUP BY content HAVING count(*) > 1)),
s AS (SELECT doc_id, place, count(*) FILTER (joined IS NOT TRUE) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM r),
g AS (SELECT doc_id, span, min(place) AS first, max(place) + 200 AS last FROM s GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(last) OVER o, 0) AS begin, first AS finish FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY span)
  UNION ALL SELECT doc_id, coalesce(max(last), 0), any_value(n) FROM b LEFT JOIN g USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(substr(digits, (2 * begin + 1)::BIGINT, (2 * (finish - begin))::BIGINT), '' ORDER BY begin) AS kept FROM k JOIN b USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(last - first) AS removed, count(*) AS spans FROM g GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM b JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
