"""Vectorised text primitives over blocks of UTF-8 documents (numpy, no loops over words).

A block is a slice of an Arrow batch: all bytes of its documents in one array,
plus document offsets. Hashes are polynomials over randomised symbols modulo
the prime 2**61 - 1 (modulo 2**64 some strings would collide for every base),
read off prefix sums, so a window of any length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = (1 << 18) - 64
#: Bytes of a long text whose prefix sums are held at a time.
PIECE = (1 << 18) - 64
#: Powers kept between blocks.
KEPT_POWERS = 1 << 20
PRIME = U(2**61 - 1)
#: Numbers computed with at a time.
CACHED = 1 << 14
LOW31, LOW30 = U(2**31 - 1), U(2**30 - 1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Multipliers of the finaliser splitmix64 (Steele, Lea and Flood, 2014): fixed values.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 of each element."""
    x = x + U((MIX[0] * (seed + 1)) & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(MIX[1])
    x ^= x >> U(27)
    x *= U(MIX[2])
    x ^= x >> U(31)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**63 modulo PRIME."""
    x = (x & PRIME) + (x >> U(61))
    x -= PRIME * (x >= PRIME)
    return x


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of numbers below PRIME, modulo PRIME; ``y`` may be one number."""
    x1, x0, y1, y0 = x >> U(31), x & LOW31, y >> U(31), y & LOW31
    middle = x1 * y0
    middle += x0 * y1
    # 2**62 is 2 and 2**61 is 1
    x1 *= y1
    x1 <<= U(1)
    x1 += middle >> U(30)
    middle &= LOW30
    middle <<= U(31)
    x1 += middle
    x0 *= y0
    return reduced((x1 & PRIME) + (x1 >> U(61)) + x0)


def steps(n: int) -> Iterator[slice]:
    """Slices of 0 .. n - 1 that are short enough for what lies between to stay in cache."""
    return (slice(lo, min(lo + CACHED, n)) for lo in range(0, n, CACHED))


class Powers:
    """Powers of a random base and of its inverse modulo the prime 2**61 - 1, grown on demand.

    Two different sequences of at most n symbols get equal hashes with a chance
    of n / 2**61 over the random base, whatever the sequences are.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(2**32, int(PRIME) - 1))
        self.symbols = rng.integers(1, 2**61 - 1, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        up, down = _grown(self.up, self.base, n), _grown(self.down, pow(self.base, -1, int(PRIME)), n)
        if n <= KEPT_POWERS:  # those of one very long text aren't kept
            self.up, self.down = up, down
        return up[:n], down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of symbol times power; bytes are first replaced by random symbols."""
        up, out, total = self.upto(len(values))[0], np.zeros(len(values) + 1, U), U(0)
        for part in steps(len(values)):
            own = values[part]
            terms = product(self.symbols[own] if own.dtype == np.uint8 else reduced(own >> U(2)), up[part])
            # in two halves, whose sums don't overflow
            high, low = np.cumsum(terms >> U(30)), np.cumsum(terms & LOW30)
            low += (high >> U(31)) + ((high & LOW31) << U(30))
            low += total
            out[part.start + 1 : part.stop + 1] = own = reduced(low)
            total = own[-1]
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end)."""
        down, out = self.upto(len(prefix))[1], np.empty(len(starts), U)
        for part in steps(len(starts)):
            first, last = starts[part], ends[part]
            out[part] = mix(product(reduced(prefix[last] + (PRIME - prefix[first])), down[first]) + (last - first).astype(U) * U(MIX[0]))
        return out


def _grown(powers: np.ndarray, base: int, n: int) -> np.ndarray:
    """At least ``n`` powers, by doubling."""
    while len(powers) < n:
        powers = np.concatenate([powers, product(powers, np.full(1, pow(base, len(powers), int(PRIME)), U))])
    return powers


#: Independent families of hashes.
FAMILIES = [Powers(seed) for seed in (11, 12, 13)]


@dataclass
class Block:
    """Documents ``lo .. hi`` of a batch."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    @cached_property
    def space(self) -> np.ndarray:
        return IS_SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words; no word crosses documents."""
        inside = ~self.space
        first = np.zeros(len(self.data), bool)
        first[self.off[:-1][self.off[:-1] < len(self.data)]] = True
        start, end = inside.copy(), inside.copy()
        if len(inside):
            start[1:] &= self.space[:-1] | first[1:]
            end[:-1] &= self.space[1:] | first[1:]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    @cached_property
    def word_off(self) -> np.ndarray:
        """Index of each document's first word, and the number of words."""
        return np.searchsorted(self.words[0], self.off)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_off))

    def prefix(self, family: int = 0) -> np.ndarray:
        return FAMILIES[family].prefix(self.data)

    @cached_property
    def _word_hashes(self) -> dict[int, np.ndarray]:
        return {}

    def word_hash(self, family: int = 0) -> np.ndarray:
        if family not in self._word_hashes:
            self._word_hashes[family] = self.span_hashes(*self.words, family)
        return self._word_hashes[family]

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
        """Hash of each span; spans come one after another. Prefix sums are held for PIECE bytes (or one longer span) at a time."""
        power, out, lo = FAMILIES[family], np.empty(len(starts), U), 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
            first = starts[lo]
            out[lo:hi] = power.spans(power.prefix(self.data[first : ends[hi - 1]]), starts[lo:hi] - first, ends[lo:hi] - first)
            lo = hi
        return out


def windows(block: Block, n: int, family: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of ``n`` words inside a document."""
    hashes = block.word_hash(family) if hashes is None else hashes
    first = np.arange(len(hashes))
    first = first[first + n <= block.word_off[1:][block.word_doc]]
    power = FAMILIES[(family + 1) % len(FAMILIES)]
    return first, power.spans(power.prefix(hashes), first, first + n)


def byte_windows(block: Block, n: int, family: int = 0, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each string of ``n`` bytes inside a document."""
    prefix = block.prefix(family) if prefix is None else prefix
    sizes = np.maximum(np.diff(block.off) - n + 1, 0)
    first = ranges(block.off[:-1], sizes)
    return first, FAMILIES[family].spans(prefix, first, first + n)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start .. start + size - 1, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Slices of whole documents, of about ``limit`` bytes or one longer document; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Block(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def cover(n: int, starts: np.ndarray, sizes) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + sizes, -1)
    return np.cumsum(step[:-1]) > 0
