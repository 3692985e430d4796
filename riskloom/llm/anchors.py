"""Anchors: a sparse, content-defined sample of the places of long windows.

Of all runs of ``gram`` elements in a window, the one with the smallest hash is the window's anchor (the
leftmost, of equal ones). Equal windows have their anchor at the same place inside, so windows need only be
looked for among those whose anchors are equal, and one anchor serves all windows beside it. Elements are
words or bytes, given as 64-bit numbers; a slice of many texts is handled in one go.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

# Odd multipliers of two independent polynomial hashes modulo 2**64, and of the anchors' own.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
GRAM_BASE = 0xC2B2AE3D27D4EB4F


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to ``n``."""
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(base, size)
    return up[: n + 1], down[: n + 1]


class Rolling:
    """Polynomial hashes of any run of ``values``."""

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = powers(base, len(values))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive elements, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate((x, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Anchors:
    text: np.ndarray  # text of each anchor
    place: np.ndarray  # where its run of elements begins, in the slice
    low: np.ndarray  # first window it serves
    high: np.ndarray  # last window it serves
    key: np.ndarray  # hash of its run
    span: np.ndarray  # two hashes of all elements of its windows, with the anchor's place among them


def find(values: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Anchors:
    """Anchors of all windows of the texts between ``bounds`` of ``values``; texts shorter than a window have none."""
    empty = np.zeros(0, np.int64)
    lengths = np.diff(bounds)
    if len(values) < window or lengths.max(initial=0) < window:
        return Anchors(empty, empty, empty, empty, empty.astype(np.uint64), np.zeros((2, 0), np.uint64))
    grams = np.arange(len(values) - gram + 1)
    hashes = Rolling(values, GRAM_BASE).of(grams, grams + gram)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(BASES[1])
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    best = (sliding_min(ranked, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.flatnonzero(lengths >= window)  # a window of the slice counts if it is within one text
    counts = lengths[whole] - window + 1
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(bounds[whole] - first, counts)
    place = best[at]
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    new[first] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at)) - 1
    low, high, place = at[starts], at[ends], place[starts]
    shift = ((place - low) * (window + 1) + (high - low)).astype(np.uint64)
    span = np.stack([mixed(Rolling(values, b).of(low, high + window) + shift * np.uint64(0x9E3779B97F4A7C15)) for b in BASES])
    return Anchors(np.repeat(whole, counts)[starts], place, low, high, hashes[place], span)


def window_hashes(values: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Two hashes for each of the windows at ``starts``."""
    return np.stack([mixed(Rolling(values, b).of(starts, starts + window)) for b in BASES])


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each low to its high, and the index of the range each comes from."""
    n = high - low + 1
    of = np.repeat(np.arange(len(low)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of], of
