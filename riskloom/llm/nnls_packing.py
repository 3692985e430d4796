"""Packing of tokenised documents by non-negative least squares over combinations of lengths.

Documents are cut into full windows and a tail. All combinations of up to three tail lengths that exactly fill a window
are enumerated; how often each is used solves a non-negative least squares problem against the histogram of tails.
Its rounded solution is dealt to the tails by their rank within their length. What is left is packed greedily:
longest first, then the longest that fits; where that does not end in a full window, the pieces are laid on a line that is cut at
every window, the last one at powers of two. So no sequence needs padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe
from riskloom.llm.texts import map_batches, per_slice
from riskloom.runtime import store, store_counted

WINDOW = 1024
END_ID = 0
ROUNDS, CLOSE = 3000, 1e-5  # most steps of the solver, and the relative change of the solution at which it ends

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, ids``: full windows of each document, and its tail.

    A document is the ids of its text and a closing id; a NULL or empty text has the closing id only. ids holds those of a tail as
    little-endian unsigned numbers of 16 bits (32 for large vocabularies), and is NULL for a full window. Repeated rows are cut each
    for itself. A long text is held once as text and once as ids. ``path`` is that of the tokenizer file on the executors.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = byte_bpe.load(path)
        small = narrow(coder.size)
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.append(coder.ids(text or ""), END_ID).astype("<u4")
            n, whole = len(ids), len(ids) // window * window
            raw = memoryview(ids.tobytes())
            rows += [(doc, a, window, zlib.crc32(raw[4 * a : 4 * (a + window)]), n, None) for a in range(0, whole, window)]
            if whole < n:
                rows.append((doc, whole, n - whole, zlib.crc32(raw[4 * whole :]), n, ids[whole:].astype(small).tobytes()))
        columns = list(zip(*rows))
        kinds = [*[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NAMES, "ids"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(texts, run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")


def narrow(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def combinations(counts: np.ndarray) -> np.ndarray:
    """Rows of two or three lengths (longest first, 0 for none) that add up to a window, of those with a count."""
    window = len(counts) - 1
    have = counts > 0
    have[window] = False
    longer = np.arange(window - 1, (window + 1) // 2 - 1, -1)
    longer = longer[have[longer] & have[window - longer]]
    found = [np.stack([longer, window - longer, np.zeros_like(longer)], 1)]
    for c in np.flatnonzero(have[: window // 3 + 1]):
        b = np.arange(c, (window - c) // 2 + 1)
        b = b[have[b] & have[window - c - b]]
        found.append(np.stack([window - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(found)


def least_squares(parts: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """How often to use each combination: x >= 0 that minimises the squares of (lengths used - counts).

    Accelerated projected gradient steps, each variable scaled by a bound of its curvature.
    """
    flat, k = parts.ravel(), parts.shape[1]

    def used(x: np.ndarray) -> np.ndarray:
        total = np.bincount(flat, np.repeat(x, k), len(counts))
        total[0] = 0
        return total

    step = 1 / used(np.ones(len(parts)))[parts].sum(1)
    x, ahead, t = np.zeros(len(parts)), np.zeros(len(parts)), 1.0
    for _ in range(rounds):
        off = used(ahead) - counts
        off[0] = 0
        new = np.maximum(0, ahead - step * off[parts].sum(1))
        if ((ahead - new) * (new - x) / step).sum() > 0:  # uphill: the momentum is given up
            t = 1.0
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / after * (new - x)
        change = np.abs(new - x).sum()
        x, t = new, after
        if change <= CLOSE * x.sum():
            break
    return x


def rounded(parts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole counts whose running sums over the combinations of one longest length are those of x, rounded."""
    order = np.lexsort((parts[:, 1], parts[:, 0]))
    total = np.cumsum(x[order])
    first = np.flatnonzero(np.diff(parts[order, 0], prepend=-1))
    base = np.repeat(np.concatenate(([0], total[first[1:] - 1])) if len(first) else first, np.diff(np.append(first, len(order))))
    sums = np.rint(total - base)
    whole = np.diff(sums, prepend=0)
    whole[first] = sums[first]
    out = np.zeros(len(parts), np.int64)
    out[order] = whole
    return out


@dataclass
class Plan:
    """Where the pieces of each length and rank go.

    slots has rows (length, first rank, first sequence, offset): ranks from there on take the sequences from there on, up to
    the next row of the length. Ranks from ``line[length]`` on lie one after the other on the line, from position ``base[length]``.
    """

    slots: np.ndarray
    line: np.ndarray
    base: np.ndarray
    ends: np.ndarray  # ends of the sequences of the line's last window
    windows: int  # full windows of the line
    line_sequence: int
    by_squares: int  # sequences from the least squares solution
    greedy: int


def greedy(left: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Patterns ``(times, lengths)`` that fill a window exactly: the longest length, then again and again the longest that fits.

    ``left`` is used up by them; lengths of patterns that end with a gap are set aside and come back at the end.
    """
    window, aside = len(left) - 1, np.zeros_like(left)
    while len(some := np.flatnonzero(left[1:]) + 1):
        pattern, gap = [], window
        while gap and len(some := some[some <= gap]):
            length = int(some[-1])
            fit = min(gap // length, int(left[length]) - pattern.count(length))
            if fit:
                pattern += [length] * fit
                gap -= fit * length
            some = some[some < length]
        lengths, uses = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        if gap:
            aside[lengths] += times * uses
        else:
            yield times, pattern
    left += aside


def plan(counts: np.ndarray) -> Plan:
    """The plan for ``counts`` (number of pieces by length, 0 to the window)."""
    left, window = counts.astype(np.int64), len(counts) - 1
    rank, slots, sequence = np.zeros(window + 1, np.int64), [], 0

    def deal(times: int, pattern: list[int]) -> None:
        nonlocal sequence
        offset = 0
        for length in pattern:
            slots.append((length, rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times

    if left[window]:
        deal(int(left[window]), [window])
        left[window] = 0
    full = sequence
    parts = combinations(left)
    if len(parts):
        x = least_squares(parts, left.astype(float))
        whole = rounded(parts, x)
        for i in np.argsort(-x, kind="stable"):
            if whole[i]:
                lengths, uses = np.unique(parts[i][parts[i] > 0], return_counts=True)
                times = int(min(whole[i], (left[lengths] // uses).min()))
                if times:
                    left[lengths] -= times * uses
                    deal(times, [int(p) for p in parts[i] if p])
    squares = sequence - full
    for times, pattern in greedy(left):
        deal(times, pattern)
    lengths = np.arange(window, -1, -1)
    base = np.zeros(window + 1, np.int64)
    tokens = left[lengths] * lengths
    base[lengths] = np.cumsum(tokens) - tokens
    windows, rest = divmod(int(tokens.sum()), window)
    powers = [1 << k for k in range(window.bit_length(), -1, -1) if rest >> k & 1]
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    return Plan(table, rank, base, windows * window + np.cumsum([0, *powers]), windows, sequence, squares, sequence - full - squares)


def places(found: Plan, window: int, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; for those on the line, its position there, else -1."""
    on_line = rank >= found.line[length]
    position = np.where(on_line, found.base[length] + (rank - found.line[length]) * length, -1)
    if not len(found.slots):
        return np.zeros_like(rank), np.zeros_like(rank), position
    keys = found.slots[:, 0] << 44 | found.slots[:, 1]
    at = np.maximum(np.searchsorted(keys, length << 44 | rank, "right") - 1, 0)
    return found.slots[at, 2] + rank - found.slots[at, 1], found.slots[at, 3], position


def parts_of(found: Plan, window: int, position: int, length: int) -> list[tuple[int, int, int, int]]:
    """``(begin, length, sequence, offset)`` of the parts of a piece on the line."""
    out, at, end = [], position, position + length
    while at < end:
        turn = at // window
        if turn < found.windows:
            low, high, sequence = turn * window, (turn + 1) * window, turn
        else:
            k = int(np.searchsorted(found.ends, at, "right")) - 1
            low, high, sequence = int(found.ends[k]), int(found.ends[k + 1]), found.windows + k
        stop = min(end, high)
        out.append((at - position, stop - at, found.line_sequence + sequence, at - low))
        at = stop
    return out


def pack(cut: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all pieces of ``cut`` (from ``pieces``).

    Places are without gaps from 0 in each sequence; a sequence holds ``window`` ids or, at most once for each size, a smaller power of two.
    Ranks within a length come from counts per hash bucket, whose number grows with the root of the table, so that a length
    that many pieces share is ranked in many tasks. The driver holds a count per length, the combinations (about
    window^2 / 12) and the plan. Equal rows are dealt in any order. Empty in, empty out.
    """
    cut, n = store_counted(cut)
    buckets = math.ceil(math.sqrt(n) / 2) or 1
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = store(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(window + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    found = plan(counts)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("place", place).join(bases, ["length", "bucket"])
    ranked = ranked.select(*NAMES, "ids", (F.col("first") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = narrow(byte_bpe.load(path).size)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset, position = places(found, window, length, rank)
            whole = np.flatnonzero(position < 0)
            kept = batch.select(NAMES).take(pa.array(whole))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence[whole]), pa.array(offset[whole])], names=[*NAMES, "sequence_id", "offset"])
            rows = []
            for i in np.flatnonzero(position >= 0).tolist():
                doc, start, n, crc, tokens, raw = (batch.column(c)[i].as_py() for c in [*NAMES, "ids"])
                own = parts_of(found, window, int(position[i]), n)
                ids = np.frombuffer(raw, small).astype("<u4") if len(own) > 1 else None
                rows += [(doc, start + a, m, crc if ids is None else zlib.crc32(ids[a : a + m].tobytes()), tokens, s, o) for a, m, s, o in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[*NAMES, "sequence_id", "offset"])

    return map_batches(ranked, run, ", ".join(f"{c} bigint" for c in [*NAMES, "sequence_id", "offset"]))
