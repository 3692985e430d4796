"""Packing of tokenised documents into training sequences.

Pieces are planned by length, not one by one: a histogram of at most ``capacity`` lengths is turned
into patterns of lengths that share a sequence. An open sequence looks for one, two or three
lengths that add up to exactly its gap, among those still available; only where none do, the longest
length that fits is added. The plan is then dealt to the pieces by their rank within their length.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.texts import map_batches, per_slice
from riskloom.runtime import store, store_counted

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 500_000  # per Python worker; a full cache starts anew

# Characters up to here are in composed form already and change case one by one; white space is
# \t, \n, \r and blank only. Texts with others, or with the start of a special token, go to the tokenizer whole.
_LAST = 0x180
_KIND = {k: "".join(re.escape(chr(i)) for i in range(_LAST) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ſ]*")
_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_KIND['L']}]+|[{_KIND['N']}]|[^\s{_KIND['L']}{_KIND['N']}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordTokenizer:
    """Ids of a word-wise lower-casing BPE tokenizer, with a bounded cache of words.

    The tokenizer never joins characters across white space or across the parts of its own pattern, so that the
    ids of a plain text are those of its words one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        split = {w: _PART.findall(w) for w in words}
        new = list({p for parts in split.values() for p in parts if p not in self.parts})
        if new:
            ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
            if len(cuts) == len(new):
                self.parts.update(zip(new, (raw[a:b] for a, b in zip(at, at[1:]))))
            else:  # some part is not one word of the tokenizer
                self.parts.update((p, np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()) for p in new)
        for w, parts in split.items():
            self.words[w] = b"".join([self.parts[p] for p in parts])

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        missing = set(words).difference(self.words)
        if missing:
            self._learn(missing)
        return b"".join(map(self.words.__getitem__, words))


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each text and a closing id, cut every ``capacity`` ids.

    Each row of ``docs`` gives at least one piece: a NULL or empty text has the closing id only. Repeated
    rows are cut each for itself. ``path`` is that of the tokenizer file on the executors.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = _tokenizer(path)
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = tokenizer.ids(text or "") + END_ID.to_bytes(4, "little")
            for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[a : a + 4 * capacity]
                rows.append((doc, piece, a // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(texts, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Histogram:
    """Counts of lengths with the searches for exact complements."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def largest(self, limit: int) -> int:
        """The longest available length up to ``limit``, or 0."""
        some = np.flatnonzero(self.left[1 : limit + 1])
        return int(some[-1]) + 1 if len(some) else 0

    def pair(self, gap: int) -> tuple[int, ...]:
        """Two available lengths of sum ``gap``, the longer as long as possible; () if there are none."""
        longer = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
        fit = (self.left[longer] > 0) & (self.left[gap - longer] > (longer * 2 == gap))
        at = fit.argmax() if len(fit) else 0
        return (int(longer[at]), int(gap - longer[at])) if len(fit) and fit[at] else ()

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that add up to ``gap``; () if there are none."""
        if self.left[gap]:
            return (gap,)
        found = self.pair(gap)
        if found:
            return found
        for a in np.flatnonzero(self.left[1:gap])[::-1] + 1:
            self.left[a] -= 1
            found = self.pair(gap - int(a))
            self.left[a] += 1
            if found:
                return (int(a), *found)
            if 3 * a < gap:  # all three would be shorter than a third
                break
        return ()


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns ``(times, lengths)`` that use up ``counts`` (length -> number).

    A pattern is repeated as long as all its lengths are available, so each one uses up a length or leaves
    fewer of it than one sequence takes: the plan's size depends on the lengths, not on the pieces.
    """
    h, patterns = Histogram(counts, capacity), []
    while length := h.largest(capacity):
        pattern, gap = [], capacity
        while length:
            pattern.append(length)
            h.left[length] -= 1
            gap -= length
            found = h.exact(gap) if gap else ()
            for x in found:
                h.left[x] -= 1
            pattern += found
            gap -= sum(found)
            length = h.largest(gap) if gap else 0
        used = np.bincount(pattern, minlength=capacity + 1)
        some = np.flatnonzero(used)
        more = int((h.left[some] // used[some]).min())
        h.left[some] -= more * used[some]
        patterns.append((1 + more, sorted(pattern, reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: runs of equal lengths in a pattern with the ranks that they serve."""
    rows, rank, sequence = [], {}, 0
    for times, lengths in patterns:
        offset = 0
        values, repeats = np.unique(lengths, return_counts=True)
        for length, k in zip(values[::-1].tolist(), repeats[::-1].tolist()):
            start = rank.get(length, 0)
            rows.append((length, start, times, sequence, offset))
            rank[length] = start + times * k
            offset += length * k
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from ``pieces``) with ``sequence_id`` and ``offset``: places without gaps in sequences of ``capacity``.

    Pieces of one length are dealt in any order; ranks within a length come from counts per hash bucket, the number of
    which grows with the root of the table, so that a length that many pieces share is ranked in many tasks.
    The driver holds one count per length and the plan. Empty in, empty out.
    """
    cut, n = store_counted(cut)
    buckets = math.ceil(math.sqrt(n) / 2) or 1
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = store(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("place", place).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        keys = table["length"] << 44 | table["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            turn, within = np.divmod(rank - table["rank"][at], table["times"][at])
            places = [pa.array(table["sequence"][at] + within), pa.array(table["offset"][at] + turn * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *places], names=[*names, "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return map_batches(ranked.select(*names, "rank"), run, schema)
