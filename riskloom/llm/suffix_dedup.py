"""Repeated byte strings by the common-prefix interval tree of an enhanced suffix array.

The array is sparse: it holds the suffixes that begin at anchors, of which every long enough string has one at the
same place wherever it occurs. Suffixes are split by anchor, sorted, and given their common-prefix lengths;
a scan with a stack lists the intervals of suffixes with a common prefix. Within each interval the suffixes are
sorted by what stands before the anchor and scanned again: where what stands before stops being equal, the
string cannot be extended to the left, and with the interval's end on the right it is a maximal repeat.
Every repeat comes with all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import windows
from riskloom.llm.texts import fields, map_batches, per_slice, utf8
from riskloom.runtime import store

LENGTH = 400
GRAM = 200
TREE_ROWS = 200  # suffixes of one anchor that a tree is built of; beyond, windows are grouped one by one


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """``length, first, last`` of all common-prefix intervals of a sorted array, by one scan with a stack.

    ``lcp[i]`` is the common prefix of elements i and i + 1; an interval holds all neighbours whose common
    prefix has the length given, which is that of its shortest.
    """
    stack: list[tuple[int, int]] = []  # length, first
    for i, length in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > length:
            height, first = stack.pop()
            yield height, first, i
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """``before, after, members``: strings of at least ``least`` bytes around an anchor that cannot be extended.

    ``left`` is what stands before each anchor, reversed, ``right`` what begins at it. Each string reaches from ``before``
    bytes before the anchor to ``after`` behind; members are all elements that have it, two or more.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [common(right[a], right[b]) for a, b in zip(order, order[1:])]
    reach = max(map(len, left), default=0)
    for after, first, last in intervals(lcp):
        if after + reach < least:
            continue
        rank = {m: r for r, m in enumerate(order[first : last + 1], first)}
        by_left = sorted(rank, key=left.__getitem__)
        before = [common(left[a], left[b]) for a, b in zip(by_left, by_left[1:])]
        for length, lo, hi in intervals(before):
            if length + after < least:
                continue
            members = by_left[lo : hi + 1]
            ranks = [rank[m] for m in members]
            if min(lcp[min(ranks) : max(ranks)]) == after:  # else the right side goes on for all members
                yield length, after, members


def _suffixes(listed: DataFrame, length: int) -> DataFrame:
    """``key, row, low, at, left, right``: what stands on both sides of each listed anchor, as far as its windows reach."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, text, spans in zip(part.column("row").to_pylist(), utf8(part), part.column("spans").to_pylist()):
            for s in spans:
                low, at = s["low"], s["at"]
                out.append((s["key"], row, at, text[low:at][::-1], text[at : low + s["n"] - 1 + length]))
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "row", "at", "left", "right"])

    return per_slice(listed.select("row", "text", "spans"), run, "key bigint, row bigint, at bigint, left binary, right binary", limit=windows.SLICE)


def _repeats(suffixes: DataFrame, length: int) -> DataFrame:
    """``key, number, row, low, end``: all occurrences of all maximal repeats of each anchor's suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            out = []
            for number, (before, after, members) in enumerate(maximal_repeats([h[3] for h in held], [h[4] for h in held], length)):
                out += [(held[m][0], number, held[m][1], held[m][2] - before, held[m][2] + after) for m in members]
            held.clear()
            if out:
                yield out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "number", "row", "low", "end"])

        ready: list[tuple] = []
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "at", "left", "right"))):
                if held and held[0][0] != item[0]:
                    for out in close():
                        ready += out
                    if len(ready) > 50_000:
                        yield batch_of(ready)
                        ready = []
                held.append(item)
        if held:
            for out in close():
                ready += out
        if ready:
            yield batch_of(ready)

    together = suffixes.repartition("key").sortWithinPartitions("key")
    return map_batches(together, run, "key bigint, number bigint, row bigint, low bigint, end bigint")


class Repeats:
    """The repeated strings of a corpus.

    ``groups`` (key, number, row, low, end) lists each maximal repeat among the distinct surroundings of an anchor with all its
    occurrences there; ``copies`` (s1, s2, row, low, end) the surroundings that occur as a whole more than once, with all
    occurrences; ``frequent`` (row, low, end) windows of anchors with very many distinct surroundings.
    """

    def __init__(self, groups: DataFrame, copies: DataFrame, frequent: DataFrame):
        self.groups, self.copies, self.frequent = groups, copies, frequent

    def spans(self) -> DataFrame:
        """``row, low, end``: byte ranges that the repeats cover."""
        cut = lambda df: df.select("row", "low", "end")
        return cut(self.groups).unionByName(cut(self.copies)).unionByName(cut(self.frequent))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, tree_rows: int = TREE_ROWS) -> Repeats:
    """Find all strings of ``length`` bytes that start at two places or more, and the maximal repeats they are part of.

    Surroundings of anchors that are equal as a whole are found by grouping and need no tree but for one of them. An anchor with
    more than ``tree_rows`` distinct surroundings has its windows grouped one by one, which is exact too and splits over tasks.
    """
    rows = windows.rows_of(docs)
    twice = windows.sketch(rows, windows.octets, length, gram)
    found = store(windows.repeated_anchors(rows, windows.octets, length, gram, twice))
    one = F.min(F.struct("row", "low", "n", "at")).alias("one")
    spans = store(found.groupBy("key", "s1", "s2").agg(F.count(F.lit(1)).alias("places"), one))
    sizes = store(spans.groupBy("key").agg(F.count(F.lit(1)).alias("spans")).filter("spans > 1"))

    again = store(spans.filter("places > 1").select("key", "s1", "s2"))
    copies = found.join(again, ["key", "s1", "s2"]).select("s1", "s2", "row", "low", (F.col("low") + F.col("n") + (length - 1)).alias("end"))

    open_spans = store(spans.join(sizes, "key").select("key", "one.*", (F.col("spans") > tree_rows).alias("many")))
    few = open_spans.filter("NOT many").groupBy("row").agg(F.collect_list(F.struct("key", "low", "n", "at")).alias("spans"))
    groups = store(_repeats(_suffixes(windows.with_lists(rows, store(few), "inner"), length), length))

    many = store(open_spans.filter("many").groupBy("row").agg(F.collect_set(F.struct("low", "n")).alias("spans")))
    single = store(windows.explode_windows(windows.with_lists(rows, many, "inner"), windows.octets, length))
    twice_found = store(single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("w1", "w2"))
    frequent = single.join(twice_found, ["w1", "w2"]).select("row", F.col("place").alias("low"), (F.col("place") + length).alias("end"))
    return Repeats(groups, copies, frequent)


def remove(docs: DataFrame, spans: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, text``: each row's bytes without the ranges ``row, low, end``.

    ``kept`` holds all bytes that are left, also those of a character that was cut through; ``text`` holds the whole characters.
    Columns of ``docs`` named in ``carry`` are handed on.
    """
    carry = carry or []
    schema = fields(docs, carry, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, text string")
    lists = store(spans.groupBy("row").agg(F.collect_set(F.struct("low", "end")).alias("spans")))
    joined = windows.with_lists(windows.rows_of(docs, carry), lists, "left").select("doc_id", "text", "spans", *carry)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, runs, kept = [], [], [], []
        for text, found in zip(utf8(part), part.column("spans").to_pylist()):
            sizes.append(len(text))
            if found:
                mask = windows.covered(found, len(text))
                runs.append(int((np.diff(np.concatenate(([0], mask.astype(np.int8)))) == 1).sum()))
                text = np.frombuffer(text, np.uint8)[~mask].tobytes()
            else:
                runs.append(0)
            gone.append(sizes[-1] - len(text))
            kept.append(text)
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), *map(part.column, carry),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text", *carry],
        )

    return per_slice(joined, run, schema)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, text`` for each row, without every byte of a repeated string of ``length``.

    All occurrences go, the first as well. Strings are judged on the input and never cross rows. NULL and empty texts have no
    bytes, shorter texts than ``length`` lose none, rows that repeat a whole text of that length lose all of it. Empty in, empty out.
    """
    return remove(docs, repeats(docs, length, gram, tree_rows).spans())
