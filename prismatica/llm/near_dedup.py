"""Near-deduplication by BagMinHash signatures, bands and verified multiset overlap.

Elements are windows of five words (a shorter text is one element), weighted by
how often they occur. BagMinHash draws, for each element, Poisson processes
over its weight range: the range is halved hierarchically ([0,1), [1,2), [2,4),
[4,8), ...), each part has a process whose rate is its length and whose points
carry a weight coordinate, and a text of weight w sees just the points below w.
Each point falls in a random register, which keeps its least time; registers of
two texts agree with the probability of their weighted Jaccard similarity. Most
elements are done after one point, since times beyond a text's largest register
can't matter.

Texts that agree in a band of registers are candidates; equal texts are joined
first. Candidates are settled in two steps:

1. Every text is compared with one leader: of the leaders of its bands' groups,
   the one that shares most bands with others, so that the copies of a text meet
   their original. One comparison a text; the links form a forest.
2. Groups that are now of one class are done. In each other group, the texts of
   the commonest class and the rest are dealt into blocks; every pair of blocks
   is one piece of work, except two of the commonest class. A piece compares only
   texts of different classes that two bounds leave open: sizes must be within
   the similarity, and distances to a common leader within the allowed distance
   (1 - similarity is a metric). Texts linked on the way count as one class.

So every pair of candidates is linked, in one class already, compared or excluded
by a bound; no link is lost. A group of copies costs one comparison a copy; what
is quadratic is only the number of texts of a group that belong to none of its
large classes. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, keyed, row_key, shuffle_width, stored, unused
from .textblocks import FAMILIES, U, Block, blocks, mix, ranges, windows

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Times are integers of this many parts, so that sums don't depend on their order.
PARTS = 2.0**36
MANY = 32
#: Margin for rounding in the bounds that choose what to compare.
MARGIN = 1e-9
#: Texts and elements of a block: what a piece of work holds at most twice (or one longer text).
BLOCK_TEXTS, BLOCK_ELEMENTS = 1024, 1 << 21
#: Texts that one piece compares with their leader.
FOLLOWERS = 128


def elements(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight) of a block, sorted by document and element."""
    first, hashes = windows(block, words)
    doc = block.word_doc[first]
    count = np.diff(block.word_off)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        power = FAMILIES[1]
        whole = power.spans(power.prefix(block.word_hash()), block.word_off[short], block.word_off[short + 1])
        doc, hashes = np.append(doc, short), np.append(hashes, whole)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Registers of ``n`` documents: the least time of each, all ones if there was no point."""
    never = np.iinfo(np.uint64).max
    registers = np.full(n * REGISTERS, never, U)
    if not len(doc):
        return registers.reshape(n, REGISTERS)
    # weight ranges [0, 1), [1, 2), [2, 4), ...: those that start below the weight
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    which = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.maximum(low, 1.0)
    share = np.minimum((weight[which] - low) / rate, 1.0)  # of the range, that the weight covers
    doc, seed = doc[which], mix(element[which] + level.astype(U) * U(0x9E3779B97F4A7C15), 5)
    time, step = np.zeros(len(doc), U), 0
    largest = np.full(n, never, U)
    while len(doc):
        draws = MANY if len(doc) < 4000 else 1
        bits = mix(seed[:, None] + (np.arange(step, step + draws, dtype=U) * U(0xD1342543DE82EF95))[None, :], 6)
        step += draws
        wait = -np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        times = time[:, None] + np.cumsum((wait * PARTS).astype(U), axis=1)
        more = mix(bits, 7)
        seen = ((more >> U(32)).astype(np.float64) * 2.0**-32 < share[:, None]) & (times < largest[doc][:, None])
        row, col = np.nonzero(seen)
        np.minimum.at(registers, doc[row] * REGISTERS + ((more[row, col] & U(0xFFFFFFFF)) % U(REGISTERS)).astype(np.int64), times[row, col])
        largest = registers.reshape(n, REGISTERS).max(axis=1)
        on = times[:, -1] < largest[doc]
        doc, seed, rate, share, time = doc[on], seed[on], rate[on], share[on], times[on, -1]
    return registers.reshape(n, REGISTERS)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """One hash for each band of registers."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=U), parts.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out ^ parts[:, :, i], 8)
    return out


def expanded(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multisets as sets of (element, which occurrence), hashed: bounds of the documents, and values.

    Sizes of intersections and unions are those of the multisets.
    """
    again = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    values = np.repeat(element, weight)
    some = again > 0
    values[some] = mix(values[some] + again[some].astype(U) * U(0x9E3779B97F4A7C15), 9)
    return np.searchsorted(np.repeat(doc, weight), np.arange(n + 1)), values


def similarities(values: np.ndarray, sizes: np.ndarray, inside: np.ndarray, size: int) -> np.ndarray:
    """Jaccard similarity of sets, given one after another, to the set that ``inside`` marks."""
    common = np.add.reduceat(inside[values].astype(np.int64), np.cumsum(sizes) - sizes)
    return common / (sizes + size - common)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            bands = band_hashes(signatures(*elements(block), block.n))
            # of the word sequence, 128 bits
            digests = np.frombuffer(b"".join(blake2b(b" ".join(block.text(i).split()), digest_size=16).digest() for i in range(block.n)), np.int64).reshape(-1, 2)
            part = batch.slice(block.lo, block.n)
            empty = np.diff(block.word_off) == 0
            ends = np.cumsum(np.append(0, np.where(empty, 0, BANDS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("key"),
                    pa.array(digests[:, 0]),
                    # texts without words are equal to none but themselves
                    pa.array(np.where(empty, part.column("key").to_numpy(), digests[:, 1])),
                    pa.ListArray.from_arrays(ends, bands[~empty].view(np.int64).ravel()),
                ],
                names=["id", "key", "digest1", "digest2", "bands"],
            )


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            bounds, values = expanded(*elements(block), block.n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(block.lo, block.n), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(bounds.astype(np.int32), values.view(np.int64))],
                names=["node", "size", "elements"],
            )


def pieces(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each piece of work, from rows that are sorted by the named columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(name).to_numpy() for name in names]
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            key = tuple(k[lo] for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _sets(piece: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and numbered elements of a piece's rows, and how many different elements there are."""
    column = piece.column("elements").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    distinct, numbers = np.unique(values, return_inverse=True)
    return off[:-1] - off[0], np.diff(off), numbers.astype(np.int32), len(distinct)


def _to_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of each text of a piece to the piece's leader."""
    for piece in pieces(batches, ["leader", "block"]):
        node, leader = piece.column("node").to_numpy(), piece.column("leader")[0].as_py()
        start, size, values, n = _sets(piece)
        lead = int(np.flatnonzero(node == leader)[0])
        inside = np.zeros(n, bool)
        inside[values[start[lead] : start[lead] + size[lead]]] = True
        found, others = similarities(values, size, inside, size[lead]), node != leader
        yield pa.RecordBatch.from_arrays([pa.array(node[others]), pa.array(np.full(others.sum(), leader)), pa.array(found[others])], names=["node", "leader", "similarity"])


def _between(similarity: float):
    """Links between the classes of a piece's two blocks."""
    far = 1 - similarity + MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, ["hash", "i", "j"]):
            own, i, j = piece.column("own").to_numpy(), piece.column("i")[0].as_py(), piece.column("j")[0].as_py()
            names, label = np.unique(piece.column("class").to_numpy(), return_inverse=True)
            if len(names) < 2:
                continue
            leader, near = piece.column("leader").to_numpy(), piece.column("similarity").to_numpy()
            start, size, values, n = _sets(piece)
            inside, found = np.zeros(n, bool), []
            second = own == j
            for c in np.flatnonzero(own == i).tolist():
                open_ = second & (label != label[c])
                if i == j:
                    open_[: c + 1] = False
                open_ &= np.minimum(size, size[c]) >= (similarity - MARGIN) * np.maximum(size, size[c])
                open_ &= (leader != leader[c]) | (np.abs(near - near[c]) <= far)
                others = np.flatnonzero(open_)
                if not len(others):
                    continue
                mine = values[start[c] : start[c] + size[c]]
                inside[mine] = True
                close = similarities(values[ranges(start[others], size[others])], size[others], inside, size[c]) >= similarity
                inside[mine] = False
                for d in others[close].tolist():
                    if label[d] != label[c]:
                        found.append((label[c], label[d]))
                        label[label == label[d]] = label[c]
            if found:
                a, b = (names[list(side)] for side in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, class)``: the root above each node of a forest ``(node, class)``; roots have no row."""
    up = parents
    while True:
        above = up.select(F.col("node").alias("class"), F.col("class").alias("above"))
        up = scratch.keep(up.join(above, "class", "left").select("node", F.coalesce("above", "class").alias("class"), F.col("above").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select("node", "class")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, class)``: one node of each connected component, for all its other nodes.

    Each round every node hooks to its least neighbour, if that is less, and what
    hangs together becomes one node; rounds grow with the logarithm of the size.
    """
    edges, labels = scratch.keep(links.select("a", "b").distinct()), None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("class")).filter("class < node")
        found = roots(hooks, scratch)
        name = lambda side: found.select(F.col("node").alias(side), F.col("class").alias(f"{side}_class"))  # noqa: B023, E731
        if labels is not None:
            labels = labels.join(name("class"), "class", "left").select("node", F.coalesce("class_class", "class").alias("class")).union(found)
        else:
            labels = found
        labels = scratch.keep(labels)
        left = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))
        edges = scratch.keep(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("class"))


def _linked(members: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """``(node, class)`` of all nodes that are linked to their class, from the members ``(hash, node)`` of all groups."""
    width = shuffle_width(members.sparkSession)
    sets = scratch.keep(texts.mapInArrow(_expand, "node long, size long, elements array<bigint>"))

    # 1. one leader a text: the text with most neighbours among the leaders of its groups
    crowd = members.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    ranked = scratch.keep(members.join(members.join(crowd, "hash").groupBy("node").agg(F.sum("n").alias("score")), "node"))
    leads = ranked.groupBy("hash").agg(F.max(F.struct("score", "node")).alias("lead"))
    led = scratch.keep(ranked.join(leads, "hash").groupBy("node").agg(F.max("lead").alias("lead")).select("node", F.col("lead.node").alias("leader")).filter("node <> leader"))
    # a leader with many texts is sent to several pieces
    sizes = led.join(sets.select("node", "size"), "node").groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    sizes = scratch.keep(sizes.select("leader", _blocks("n", "elements", FOLLOWERS).alias("blocks")))
    followers = led.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("node"))
    work = followers.union(heads).join(sets, "node").repartition(width, "leader", "block").sortWithinPartitions("leader", "block")
    told = scratch.keep(work.select("leader", "block", "node", "elements").mapInArrow(_to_leader, "node long, leader long, similarity double"))
    labels = roots(told.filter(F.col("similarity") >= similarity).select("node", F.col("leader").alias("class")), scratch)

    # 2. groups of several classes, block by block
    state = (
        ranked.select("node").distinct().join(told, "node", "left").join(labels, "node", "left").join(sets.select("node", "size"), "node")
        .select("node", "size", F.coalesce("class", "node").alias("class"), F.coalesce("leader", "node").alias("leader"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    )
    placed = scratch.keep(members.join(state, "node"))
    by_class = placed.groupBy("hash", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    major = by_class.groupBy("hash").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("elements").alias("elements"), F.max(F.struct("n", "elements", "class")).alias("most"))
    major = major.filter("classes > 1").select(
        "hash",
        F.col("most.class").alias("most"),
        _blocks("most.n", "most.elements").alias("most_blocks"),
        _blocks(F.col("n") - F.col("most.n"), F.col("elements") - F.col("most.elements")).alias("blocks"),
    )
    code, is_most = F.xxhash64("node"), F.col("class") == F.col("most")
    work = (
        placed.join(major, "hash")
        .withColumn("own", F.when(is_most, F.col("blocks") + F.pmod(code, "most_blocks")).otherwise(F.pmod(code, "blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_most, F.col("blocks")).otherwise(F.col("blocks") + F.col("most_blocks")) - 1)))
        .select("hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "class", "leader", "similarity")
        .join(sets.select("node", "elements"), "node")
        .repartition(width, "hash", "i", "j")
        .sortWithinPartitions("hash", "i", "j")
    )
    joined = components(work.mapInArrow(_between(similarity), "a long, b long"), scratch).select(F.col("node").alias("class"), F.col("class").alias("joined"))
    return scratch.keep(placed.select("node", "class").distinct().join(joined, "class", "left").select("node", F.coalesce("joined", "class").alias("class")))


def _blocks(texts, elements, most: int | None = None):
    """Number of blocks that so many texts and elements are dealt into."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.greatest(F.ceil(column(texts) / (most or BLOCK_TEXTS)), F.ceil(column(elements) / BLOCK_ELEMENTS)).cast("long")


def _classes(docs: DataFrame, id_column: str, text_column: str, similarity: float, scratch: Scratch) -> DataFrame:
    """``(id, key, least)``: each row's place, and that of the row that stays of its class."""
    rows = keyed(docs, id_column, text_column)
    signed = scratch.keep(rows.mapInArrow(_sign, "id long, key long, digest1 long, digest2 long, bands array<bigint>"))
    # the least id stays, a row without one only if there is no other
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    distinct = scratch.keep(signed.groupBy("digest1", "digest2").agg(F.min("key").alias("node"), F.min(place).alias("least"), F.first("bands").alias("bands")))
    banded = distinct.select("node", F.explode("bands").alias("hash"))
    shared = banded.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = scratch.keep(banded.join(shared, "hash"))
    texts = rows.select(F.col("key").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    labels = _linked(members, texts, similarity, scratch).join(distinct.select("node", "least"), "node")
    best = labels.join(labels.groupBy("class").agg(F.min("least").alias("best")), "class").select("node", "best")
    nodes = distinct.select("digest1", "digest2", "node", "least").join(best, "node", "left").select("digest1", "digest2", F.coalesce("best", "least").alias("least"))
    return signed.select("id", "key", "digest1", "digest2").join(nodes, ["digest1", "digest2"]).select("id", "key", "least")


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, ``class_id`` (least id of its class), ``kept`` (it is the row that stays).

    Texts of one word sequence are in one class; null, empty and blank texts are
    each alone. Texts of fewer than five words are alike only if equal. Of a
    class the row with the least id stays (rows that repeat id and text: all of
    them are marked), a row without id only if no row has one; the class id is
    then null. Texts of any length are compared whole. Rows may repeat an id. An
    empty table gives no rows, other columns are ignored.
    """
    with Scratch(docs.sparkSession, "near") as scratch:
        found = _classes(docs, id_column, text_column, similarity, scratch)
        out = found.select(F.col("id").alias(id_column), F.col("least.id").alias("class_id"), (F.col("key") == F.col("least.key")).alias("kept"))
        return stored(out, "near-classes")


def drop_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: that of the least id; of repeated rows one."""
    key, again = unused(docs, "row_key"), unused(docs, "again")
    with Scratch(docs.sparkSession, "near") as scratch:
        kept = stored(_classes(docs, id_column, text_column, similarity, scratch).filter("key = least.key").select(F.col("key").alias(key)).distinct(), "near-kept")
    rows = docs.withColumn(key, row_key(id_column, text_column)).join(kept, key)
    return rows.withColumn(again, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(again) == 1).select(*columns(docs))


#: All pairs that share an element, and the components of those that are similar enough.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, md5(CASE WHEN len(words) >= 5 THEN array_to_string(words[i:i + 4], ' ') ELSE array_to_string(words, ' ') END) AS element
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)),
e AS (SELECT doc_id, element, count(*) AS weight FROM s GROUP BY ALL),
n AS (SELECT doc_id, sum(weight) AS total FROM e GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.weight, b.weight)) AS common FROM e a JOIN e b ON a.element = b.element AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common::DOUBLE / (x.total + y.total - common)::DOUBLE >= 0.8),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
p AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT p.a, u.b FROM p JOIN u ON u.a = p.b)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM p GROUP BY a
"""
