"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An
n-gram is bound as the product of its letters' vectors, each rotated by its
place. A document bundles (sums) the vectors of its n-grams and is scaled to
length one; a language's prototype bundles its documents. A document gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
GRAM = 3
SEED = 17
UNKNOWN = "und"
CHUNK = 1 << 20
POINTS = 0x110000


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(POINTS)), bool, POINTS)


_VECTORS: dict[int, np.ndarray] = {}


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """Random signs of each code point; the same everywhere. 0 stands for all that isn't a letter."""
    if len(_VECTORS) > 50_000:
        _VECTORS.clear()
    for p in points.tolist():
        if p not in _VECTORS:
            _VECTORS[p] = np.random.default_rng([SEED, p]).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)
    return np.stack([_VECTORS[p] for p in points.tolist()]) if len(points) else np.zeros((0, DIMENSIONS), np.int8)


def bind(grams: np.ndarray) -> np.ndarray:
    """Vectors of n-grams given as rows of code points."""
    points, place = np.unique(grams, return_inverse=True)
    vectors, place = letter_vectors(points), place.reshape(grams.shape)
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for i in range(GRAM):
        out *= np.roll(vectors, GRAM - 1 - i, axis=1)[place[:, i]]
    return out.astype(np.float32)


def profiles(texts: list[str]) -> np.ndarray:
    """Unit vectors of documents; zero for those without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHUNK):
            size += len(texts[hi]) + 2
            hi += 1
        _profiles(texts[lo:hi], out[lo:hi])
        lo = hi
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def _profiles(texts: list[str], out: np.ndarray) -> None:
    # a blank on both sides of each text: its first and last letters have n-grams, and none crosses texts
    texts = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    off = np.cumsum([0, *map(len, texts)])
    points = np.where(letters()[points], points, 0)
    # runs of other characters count as one blank
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] > 0) | (points[:-1] > 0)
    keep[off[:-1]] = True
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    points = points[keep]
    code = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    inside = (doc[:-2] == doc[2:]) & ((points[:-2] > 0) | (points[1:-1] > 0) | (points[2:] > 0))
    distinct, place = np.unique(code[inside], return_inverse=True)
    if not len(distinct):
        return
    doc = doc[:-2][inside]
    pair, count = np.unique(doc * len(distinct) + place, return_counts=True)
    doc, place = pair // len(distinct), pair % len(distinct)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    step = 1 << 14  # n-grams bound at a time
    for first in range(0, len(distinct), step):
        some = distinct[first : first + step]
        vectors = bind(np.stack([some >> 42, some >> 21 & 0x1FFFFF, some & 0x1FFFFF], 1))
        for i in range(len(texts)):
            own = slice(bounds[i], bounds[i + 1])
            a, b = np.searchsorted(place[own], [first, first + step])
            if a < b:
                out[i] += count[own][a:b].astype(np.float32) @ vectors[place[own][a:b] - first]


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            vectors, names = profiles([t or "" for t in part.column("text").to_pylist()]), np.array(part.column("lang").to_pylist(), object)
            for name in set(names.tolist()):
                # sums of 1/2**20ths, so that they agree in any order
                own = np.rint(vectors[names == name] * 2.0**20).astype(np.int64).sum(axis=0)
                sums[name] = sums.get(name, 0) + own
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"])


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows with a language, bundled where they lie.

    What reaches the driver is one vector a language. Rows without text or
    language teach nothing, repeated rows count each time; an empty table gives
    no prototypes.
    """
    parts = (
        docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
        .select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
        .mapInArrow(_bundle, "lang string, vector array<bigint>")
    )
    at = F.posexplode("vector").alias("place", "value")
    sums = parts.select("lang", at).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("vector")).collect()
    found = {r["lang"]: np.array([x["value"] for x in r["vector"]], float) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred, score`` (the cosine, at least 0).

    ``und`` with score 0 for null texts, texts without a letter, and if nothing
    was learned. Ties go to the first language by name. Repeated rows, and rows
    without an id, get results like any other; texts of any length are profiled
    whole. An empty table gives no rows, other columns are ignored.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names], 1).astype(np.float32) if names else np.zeros((DIMENSIONS, 0), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                vectors = profiles([t or "" for t in part.column("text").to_pylist()])
                known = (vectors != 0).any(axis=1) & bool(names)
                cosine = vectors @ matrix if names else np.zeros((len(vectors), 1), np.float32)
                best = cosine.argmax(axis=1)
                score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(float)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return (
        docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
        .mapInArrow(run, "id long, lang_pred string, score double")
        .withColumnRenamed("id", id_column)
    )
