"""Burrows-Wheeler transform and common prefixes of a collection, built by columns.

Round j inserts, for every string at once, the suffix of length j: its place
follows from the place of the suffix one shorter and the rank of its first
symbol among the symbols written so far, and its common prefixes with both
neighbours follow from the least common prefix between the places of their
tails. Each round reads and rewrites the transform and the prefix lengths as
two sequential streams. Callers bound the size of a collection, so that the
streams are held in memory instead of files.
"""

from __future__ import annotations

import numpy as np

CAP = 255


def build(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefix lengths (at most CAP) of all suffixes of the strings.

    ``data`` are bytes below 255, ``off`` the bounds of the strings. Symbol 0
    ends every string; ends sort by the strings' order and never match. A symbol
    is its byte plus one, the symbol before a whole string is 0.
    """
    m, ends, sizes = len(off) - 1, off[1:], np.diff(off)
    symbol = lambda active, done: np.where(sizes[active] > done, data[np.maximum(ends[active] - done - 1, 0)] + np.uint8(1), 0).astype(np.uint8)
    active = np.arange(m)
    bwt, lcp, place = symbol(active, 0), np.zeros(m, np.uint8), np.arange(m)
    for done in range(int(sizes.max(initial=0))):
        longer = sizes[active] > done
        active, place = active[longer], place[longer]
        order = np.argsort(bwt, kind="stable")  # places by symbol
        sorted_symbols = bwt[order]
        ended = int(np.searchsorted(sorted_symbols, 0, "right"))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        at = at[place]
        new = at - ended + m
        # common prefixes with the places of the same symbol just before and after
        low, high = _shared(lcp, order, sorted_symbols, at), None
        following = at + 1
        inside = following < len(order)
        inside[inside] = sorted_symbols[following[inside]] == sorted_symbols[at[inside]]
        high = _shared(lcp, order, sorted_symbols, following[inside])

        total = len(bwt) + len(active)
        fresh = np.zeros(total, bool)
        fresh[new] = True
        grown, grown_lcp = np.empty(total, np.uint8), np.empty(total, np.uint8)
        grown[~fresh], grown_lcp[~fresh] = bwt, lcp
        grown[new] = symbol(active, done + 1)
        grown_lcp[new] = low
        grown_lcp[new[inside] + 1] = high
        bwt, lcp, place = grown, grown_lcp, new
    return bwt, lcp


def _shared(lcp: np.ndarray, order: np.ndarray, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Common prefix of the suffix that place ``order[at]`` continues and the one before it in order."""
    out = np.zeros(len(at), np.uint8)
    same = at > 0
    same[same] = symbols[at[same] - 1] == symbols[at[same]]
    if same.any():
        first, last = order[at[same] - 1] + 1, order[at[same]] + 1
        pairs = np.stack([first, np.minimum(last, len(lcp) - 1)], 1).ravel()
        least = np.minimum.reduceat(lcp, pairs)[::2]
        # a range that ends with the array was cut by one
        least = np.where(last == len(lcp), np.minimum(least, lcp[-1]), least)
        out[same] = np.minimum(least.astype(np.int64) + 1, CAP)
    return out


def repeated_windows(data: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """For each place of ``data``: whether the string of ``n`` bytes there (inside its string) stands elsewhere too."""
    if n > CAP:
        raise ValueError(f"windows of at most {CAP} bytes")
    bwt, lcp = build(data, off)
    group = np.cumsum(lcp < n)
    several = np.bincount(group)[group] > 1
    back = np.empty(len(bwt), np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    out = np.zeros(len(data), bool)
    sizes, place = np.diff(off), np.arange(len(off) - 1)
    active = np.arange(len(off) - 1)
    for length in range(1, int(sizes.max(initial=0)) + 1):
        longer = sizes[active] >= length
        active, place = active[longer], back[place[longer]]
        if length >= n:
            out[off[1:][active] - length] = several[place]
    return out
