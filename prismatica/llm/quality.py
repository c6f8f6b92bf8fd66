"""Quality rules: fixed base rules and a calibrated classifier on hashed n-grams.

The classifier is a logistic regression on hashed word n-grams (one and two
words) and hashed character n-grams (three to five code points), each as shares
of the text. It is trained on a bounded sample of labelled rows, whose sparse
features come to the driver, and calibrated by Platt scaling on a part that
training hasn't seen. Documents are scored whole, in Arrow batches; a score is a
few weight sums read off prefix sums, so the model (fixed size) is all that is
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key
from .textblocks import U, Block, blocks, cover, mix, steps, windows

WORD_GRAMS = (1, 2)
CHARACTER_GRAMS = (3, 4, 5)
#: Bits of a hashed feature; word and character n-grams have a half of the weights each.
BITS = 18
#: Labelled rows used at most: those whose hashed ids are least.
SAMPLE = 2000
#: Features of those rows held at most (8 bytes each): further rows are left out of the sample.
SAMPLE_FEATURES = 1 << 21
#: Features summed at a time in training.
PART = 1 << 18
#: Rejected below this calibrated probability of good quality.
KEEP_AT = 0.5
SCALE = 30.0
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, block: Block) -> np.ndarray:
        """Calibrated probability of good quality of each document."""
        raw = np.full(block.n, self.bias)
        for hashed, bounds in features(block):
            raw += SCALE * _means(self.weights[hashed], bounds)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off]


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(_sums(values, bounds), axis=1)[:, 0] / np.maximum(bounds[:, 1] - bounds[:, 0], 1)


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram: hashed features at each place, and each document's first place and end."""
    for n in WORD_GRAMS:
        yield _grams(block.word_hash(), n, 0), _places(block.word_off, n)
    points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), "<u4")
    off = np.append(0, np.cumsum((block.data & 0xC0) != 0x80))[block.off]
    for n in CHARACTER_GRAMS:
        yield _grams(points, n, 1), _places(off, n)


def _grams(values: np.ndarray, n: int, half: int) -> np.ndarray:
    """The feature of the ``n`` values from each place, in one of the halves of the weights."""
    out = np.zeros(len(values), np.int32)
    for part in steps(max(len(values) - n + 1, 0)):
        hashed = np.zeros(part.stop - part.start, U)
        for i in range(n):
            hashed += _turned(values[part.start + i : part.stop + i].astype(U), i)
        out[part] = (_scattered(hashed) >> U(64 - BITS + 1)).astype(np.int32)
    out += half << (BITS - 1)
    return out


def _turned(values: np.ndarray, place: int) -> np.ndarray:
    """Values times an odd constant of the place."""
    return values * U((0x9E3779B97F4A7C15 * (2 * place + 1) ** 5) & (2**64 - 1) | 1)


def _scattered(values: np.ndarray) -> np.ndarray:
    """High bits that depend on all bits."""
    values ^= values >> U(29)
    values *= U(0xBF58476D1CE4E5B9)
    return values


def _places(off: np.ndarray, n: int) -> np.ndarray:
    return np.stack([off[:-1], np.maximum(off[1:] - n + 1, off[:-1])], 1)


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """The base counts of each document of a block."""
    off, space = block.off, block.space
    words = np.diff(block.word_off)
    lead = ((block.data & 0xC0) != 0x80) & ~space
    # lines: one per newline, and one at each document's end
    newline = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([off[:-1], newline + 1]))
    line_doc = np.sort(np.concatenate([np.arange(block.n), np.searchsorted(off, newline, "right") - 1]))
    ends = np.append(starts[1:], len(block.data)) if len(starts) else starts
    not_last = np.append(line_doc[1:] == line_doc[:-1], False) if len(starts) else np.zeros(0, bool)
    ends = ends - not_last
    filled = np.diff(_sums(~space, np.stack([starts, ends], 1)), axis=1)[:, 0] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends, line_doc = starts[filled], ends[filled], line_doc[filled]
    hashes = block.span_hashes(starts, ends, 1)
    first = np.unique(mix(hashes + line_doc.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
    duplicates = np.bincount(line_doc, minlength=block.n) - np.bincount(line_doc[first], minlength=block.n)

    at, hashes = windows(block, REPEAT_WINDOW)
    _, inverse, counts = np.unique(mix(hashes + block.word_doc[at].astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    repeats = cover(len(block.words[0]), at[counts[inverse] > 1], REPEAT_WINDOW)
    return {
        "n_words": words,
        "word_chars": np.diff(_sums(lead, off)),
        "n_symbols": np.diff(_sums(SYMBOLS[block.data], off)),
        "n_dup_lines": duplicates,
        "n_repeat_words": np.diff(_sums(repeats, block.word_off)),
    }


def judged(block: Block, model: Classifier | None) -> dict[str, np.ndarray]:
    out = base_counts(block)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["probability"] = model.probability(block) if model else np.ones(block.n)
    out["kept"] = ~out["base_failed"] & (out["probability"] >= KEEP_AT)
    return out


# training


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            found, rows = list(features(block)), []
            for i in range(block.n):
                own = []
                for hashed, bounds in found:
                    at, count = np.unique(hashed[bounds[i, 0] : bounds[i, 1]], return_counts=True)
                    own.append((at, count / max(count.sum(), 1)))
                # a feature of two sizes of n-grams has the sum of its shares
                at, place = np.unique(np.concatenate([a for a, _ in own]), return_inverse=True)
                rows.append((at.astype("<u4").tobytes(), np.bincount(place, np.concatenate([c for _, c in own]), len(at)).astype("<f4").tobytes(), len(at)))
            at, share, size = zip(*rows)
            part = batch.slice(block.lo, block.n)
            yield pa.RecordBatch.from_arrays(
                [part.column("good"), part.column("order"), part.column("id"), pa.array(size, pa.int64()), pa.array(at, pa.binary()), pa.array(share, pa.binary())],
                names=["good", "order", "id", "size", "at", "share"],
            )


def fit(rows: list, rounds: int = 60, rate: float = 0.05, decay: float = 1e-3) -> Classifier | None:
    """Logistic regression by Adam on sparse rows; None without both labels."""
    good = np.array([r["good"] for r in rows], float)
    held = np.array([r["order"] % 4 == 0 for r in rows])
    if not len(rows) or not 0 < good[~held].sum() < (~held).sum():
        return None
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [r["size"] for r in rows])
    at = np.concatenate([np.frombuffer(r["at"], "<u4") for r in rows]).view(np.int32)
    share = np.concatenate([np.frombuffer(r["share"], "<f4") for r in rows])
    share *= np.float32(SCALE)
    size = 1 << BITS
    # both labels weigh alike in training; calibration brings the true shares back
    importance = np.where(good > 0, 0.5 / good[~held].sum(), 0.5 / (~held & (good == 0)).sum()) * ~held
    w, bias, m, v, mb, vb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    # sums by parts: what lies between stays small beside the features
    parts = [slice(lo, lo + PART) for lo in range(0, len(at), PART)]
    scores = lambda w: sum(np.bincount(row[p], w[at[p]] * share[p], len(rows)) for p in parts)
    for t in range(1, rounds + 1):
        raw = scores(w) + bias
        error = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - good) * importance
        grad = sum(np.bincount(at[p], error[row[p]] * share[p], size) for p in parts) + decay * w / size
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    raw = scores(w) + bias
    model = Classifier(w, float(bias))
    if 0 < good[held].sum() < held.sum():
        model.slope, model.shift = platt(raw[held], good[held])
    return model


def platt(raw: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic map from raw scores to probabilities (Newton, smoothed targets)."""
    target = np.where(good > 0, (good.sum() + 1) / (good.sum() + 2), 1 / (len(good) - good.sum() + 2))
    x, beta = np.stack([raw, np.ones_like(raw)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE, most: int = SAMPLE_FEATURES) -> Classifier | None:
    """Train on at most ``sample`` labelled rows that hold at most ``most`` features; every fourth calibrates.

    Rows without label or text are left out, repeated labels count once, and of
    rows that repeat an id one is taken. Texts are taken whole: those by which
    the features would exceed ``most`` are left out. None if either label is
    missing; then only the base rules judge.
    """
    ident = F.col(id_column).cast("long")
    some = (
        labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(ident.alias("id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("good"))
        .withColumn("order", F.xxhash64("id", F.lit(7)))
        .orderBy("order", "id")
        .limit(sample)
    )
    # the broadcast side has ``sample`` narrow rows at most
    rows = docs.filter(F.col(text_column).isNotNull()).select(ident.alias("id"), F.col(text_column).cast("string").alias("text"), row_key(id_column, text_column).alias("key")).join(F.broadcast(some), "id")
    one = rows.groupBy("id", "good", "order").agg(F.min_by("text", "key").alias("text"))
    with Scratch(docs.sparkSession, "train") as scratch:
        sparse = scratch.keep(one.select("good", "order", "id", "text").mapInArrow(_sparse, "good int, order long, id long, size long, at binary, share binary"))
        # at most ``sample`` rows here, and ``most`` features in those collected
        held, chosen = 0, []
        for r in sorted(sparse.select("order", "id", "size").collect()):
            if held + r["size"] <= most:
                held += r["size"]
                chosen.append(r["id"])
        found = sparse.filter(F.col("id").isin(chosen)).collect() if chosen else []
    # in an order of their own, so that sums and so the model agree between runs
    found.sort(key=lambda r: (r["order"], r["id"]))
    return fit(found)


# applying


def judge(docs: DataFrame, model: Classifier | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, base counts, ``base_failed, kept, probability``.

    Null and empty texts have no words and fail. Repeated rows, and rows without
    an id, are judged like any other; texts of any length are scored whole. An
    empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*BASE, "base_failed", "kept", "probability"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                out = judged(block, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(block.lo, block.n), *[pa.array(out[n], k) for n, k in zip(names, kinds)]], names=["id", *names])

    schema = "id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, kept boolean, probability double"
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, model: Classifier | None, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(batch.schema.get_field_index(text_column)).cast(pa.string())):
                yield batch.slice(block.lo, block.n).filter(pa.array(judged(block, shared.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
