"""How the tokens of two tokenizers correspond over a corpus.

A text with a blank before it is encoded by both. Where tokens of both end at the same byte a group ends; all its tokens of one
are linked with all of the other. Most groups hold one token of each, of the same bytes: such a pair is an entry of the identity
map (id of A -> id of B), and the documents that hold it are counted in a vector as long as A's vocabulary. Only the other pairs are
shuffled, once for each chunk of texts that holds them.

Tokens of neither tokenizer reach over the blank between two words, so that the distinct words of a chunk are aligned and not its texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe
from riskloom.llm.texts import map_batches, slices
from riskloom.runtime import store

CHUNK = 1_000_000  # bytes of text that share a list of words; a longer text is a chunk of its own
SEGMENT = 500_000  # characters of a text that are cut into words at a time, and words whose groups are spelled at a time
INNER = re.compile(r"(?<=\S) (?=\S)")
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


class Tokenizers:
    """A byte-level BPE (A) and a SentencePiece model (B), the bytes of their tokens, and the identity map."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = byte_bpe.load(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("pieces that reach over a blank are not supported")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.a.bytes, self.bytes_b))
        # of a piece and a byte that are the same, the piece is the one in use
        order = sorted(range(len(names)), key=lambda i: self.b.is_byte(i))
        known = {self.bytes_b[i]: i for i in reversed(order) if not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.identity = np.array([known.get(raw, -1) for raw in self.a.bytes], np.int64)

    def encode(self, words: list[str], odd: list[str]) -> list[np.ndarray]:
        """Ids of ``words`` and then ``odd``, a blank before each, by A and by B; words have no white space at their ends nor blanks."""
        # A never joins over a blank before a word, so that they are encoded in one go
        ids_a = [self.a.plain_ids(" " + " ".join(words))] if words else []
        ids_b = chain.from_iterable(self.b.encode(words + odd, num_threads=1))
        return [np.concatenate([np.zeros(0, np.int64), *ids_a, *(self.a.plain_ids(" " + w) for w in odd)]), np.fromiter(ids_b, np.int64)]

    def gives_back(self, text: str) -> bool:
        """Whether both spell ``text`` byte by byte."""
        a, b = self.encode([], [text])
        raw = b" " + text.encode()
        return b"".join([self.a.bytes[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw


@cache
def load(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def segments(text: str) -> Iterator[str]:
    """The text in parts of about ``SEGMENT`` characters, cut at a blank between two other characters, which is left out."""
    at = 0
    while found := INNER.search(text, at + SEGMENT):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def plain(part: str) -> bool:
    """Whether each blank of ``part`` is between two characters that are no white space, as are its first and last."""
    if part[0].isspace() or part[-1].isspace() or "  " in part:
        return False
    return not any(c in part and (c + " " in part or " " + c in part) for c in WHITE)


def within(bound: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``bound[r]`` to ``bound[r + 1]`` for each of ``rows``, one after the other, and the place in ``rows`` of each."""
    n = bound[rows + 1] - bound[rows]
    place = np.repeat(np.arange(len(rows)), n)
    return np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bound[rows], n), place


def summed(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Exact sums of ``values`` from each bound to the next."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[bound])


class Words:
    """Alignments of a list of words.

    ``n_a, n_b, n_groups, n_links`` and ``spelling`` by word; ``keys`` the distinct pairs (A id << 32 | B id); the links of word w are
    ``pair[bound[w] : bound[w + 1]]``, each ``times`` often. ``bad`` marks words that a tokenizer doesn't give back byte by byte; they have no tokens.
    """

    def __init__(self, tokenizers: Tokenizers, words: list[str], odd: list[str]):
        raw = [b" " + w.encode() for w in words + odd]
        size = np.fromiter(map(len, raw), np.int64)
        raw, n = b"".join(raw), len(raw)
        self.bad = np.zeros(n, bool)
        a, b = tokenizers.encode(words, odd)
        if any(b"".join(map(spell.__getitem__, ids.tolist())) != raw for spell, ids in ((tokenizers.a.bytes, a), (tokenizers.bytes_b, b))):
            self.bad = np.array([not tokenizers.gives_back(w) for w in words + odd], bool)
            good = lambda own, x: [w for w, bad in zip(own, x) if not bad]
            a, b = tokenizers.encode(good(words, self.bad), good(odd, self.bad[len(words) :]))
        ends_a, ends_b = np.cumsum(tokenizers.size_a[a]), np.cumsum(tokenizers.size_b[b])
        word_ends = np.cumsum(size * ~self.bad)
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cut_a, cut_b = (np.concatenate(([0], np.searchsorted(e, ends, "right"))) for e in (ends_a, ends_b))
        groups = np.concatenate(([0], np.searchsorted(ends, word_ends, "right")))  # every word ends with a group
        self.n_groups, self.n_a, self.n_b = np.diff(groups), np.diff(cut_a[groups]), np.diff(cut_b[groups])
        in_b = np.diff(cut_b)
        links = np.diff(cut_a) * in_b
        before = np.concatenate(([0], np.cumsum(links)))
        self.n_links = np.diff(before[groups])
        group = np.repeat(np.arange(len(ends)), links)
        at = np.arange(len(group)) - before[group]
        key = a[cut_a[group] + at // in_b[group]] << 32 | b[cut_b[group] + at % in_b[group]]
        self.keys, code = np.unique(key, return_inverse=True)
        base = max(len(self.keys), 1)
        both, self.times = np.unique(np.repeat(np.arange(n), self.n_links) * base + code, return_counts=True)
        self.pair, self.bound = both % base, np.searchsorted(both, np.arange(n + 1) * base)
        self.spelling = self._spelled(a, b, cut_a, cut_b, groups)

    @staticmethod
    def _spelled(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, groups: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each word."""
        a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cut_a, cut_b, groups = cut_a.tolist(), cut_b.tolist(), groups.tolist()
        each = [
            f"{a[p]}|{b[r]}" if q - p == 1 == s - r else f"{','.join(a[p:q])}|{','.join(b[r:s])}"
            for p, q, r, s in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])
        ]
        return [";".join(each[p:q]) for p, q in zip(groups, groups[1:])]


class Chunk:
    """The texts of a chunk by the words that they hold: those of text t are ``word[bound[t] : bound[t + 1]]``, each ``count`` often."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str | None]):
        index: dict[str, int] = {}
        odd: list[str] = []
        occurrences = []
        for text in texts:
            own = [np.zeros(0, np.int32)]
            for part in segments(text) if text else ():
                if plain(part):
                    words = part.split(" ")
                    own.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
                else:  # counted from the end of the words, whose number isn't known yet
                    odd.append(part)
                    own.append(np.array([-len(odd)], np.int32))
            occurrences.append(np.concatenate(own))
        self.words = al = Words(tokenizers, list(index), odd)
        found, digests, bad = [], [], al.bad.any()
        for own in occurrences:
            own = np.where(own < 0, len(index) - 1 - own, own)
            if bad and al.bad[own].any():  # then the text as a whole isn't given back either
                own = own[:0]
            digests.append(self._digest(own) if len(own) else "")
            found.append(np.unique(own, return_counts=True))
        self.word, self.count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found))
        self.bound = np.cumsum([0, *(len(w) for w, _ in found)])
        self.numbers = [summed(x[self.word] * self.count, self.bound) for x in (al.n_a, al.n_b, al.n_groups, al.n_links)]
        self.digests = digests

    def _digest(self, own: np.ndarray) -> str:
        spelling, digest = self.words.spelling, hashlib.sha256()
        for at in range(0, len(own), SEGMENT):
            digest.update((";" * (at > 0) + ";".join([spelling[w] for w in own[at : at + SEGMENT].tolist()])).encode())
        return digest.hexdigest()

    def documents(self) -> np.ndarray:
        """For each distinct pair, how many texts of the chunk hold it."""
        al = self.words
        text = np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))
        at, place = within(al.bound, self.word)
        held = np.unique(text[place] * max(len(al.keys), 1) + al.pair[at])
        return np.bincount(held % max(len(al.keys), 1), minlength=len(al.keys))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, compressed, with their number."""
    raw = x.astype("<i8" if x.dtype == np.int64 and len(x) and int(x.max()) >> 31 else "<i4").tobytes()
    return len(x).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n, size = (int.from_bytes(raw[k : k + 8], "little") for k in (0, 8))
    kind = "<i8" if n and size == 8 * n else "<i4"
    return np.frombuffer(pa.decompress(raw[16:], size, "zstd", asbytes=True) if n else b"", kind).astype(np.int64)


PARTS = (
    "chunk bigint, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, words bigint, word binary, count binary, "
    "pair binary, times binary, links binary, keys binary, shuffled array<bigint>, documents array<bigint>, ids array<int>, ns array<bigint>"
)
HEAD = ["word", "count", "pair", "times", "links", "keys"]


def parts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each text with its numbers, those of a chunk under one number ``chunk``.

    The first row of a chunk also has the words of all its texts, the links of each word, and the pairs outside the identity map with the number of texts
    that hold each. A last row of each task (chunk NULL) has how many texts hold each pair of the identity map, by A's id.
    """
    names = [f.split()[0] for f in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, number = load(a, b), TaskContext.get().partitionId() << 32
        vector = np.zeros(len(tokenizers.identity), np.int64)

        def rows(values: dict, n: int) -> pa.RecordBatch:
            columns = [values.get(c, [None] * n) for c in names]
            kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(x, kinds[f.split()[1]]) for x, f in zip(columns, PARTS.split(", "))], names=names)

        for batch in batches:
            for part in slices(batch, limit=CHUNK):
                chunk = Chunk(tokenizers, part.column("text").to_pylist())
                al, n, in_texts = chunk.words, part.num_rows, chunk.documents()
                id_a, id_b = al.keys >> 32, al.keys & 0xFFFFFFFF
                same = tokenizers.identity[id_a] == id_b
                np.add.at(vector, id_a[same], in_texts[same])
                first = lambda x: [x, *[None] * (n - 1)]
                yield rows(
                    {
                        "chunk": [number] * n, "place": range(n), "doc_id": part.column("doc_id").to_pylist(), "groups_sha256": chunk.digests,
                        "words": np.diff(chunk.bound), **dict(zip(NUMBERS, chunk.numbers)),
                        # steps between the sorted words of a text are small
                        "word": first(packed(np.diff(chunk.word, prepend=0).astype(np.int32))), "count": first(packed(chunk.count.astype(np.int32))),
                        "pair": first(packed(al.pair)), "times": first(packed(al.times)), "links": first(packed(np.diff(al.bound))),
                        "keys": first(packed(np.diff(al.keys, prepend=0))), "shuffled": first(al.keys[~same]), "documents": first(in_texts[~same]),
                    },
                    n,
                )
                number += 1
        some = np.flatnonzero(vector)
        yield rows({"ids": [some], "ns": [vector[some]]}, 1)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(texts, run, PARTS)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs``.

    The count of a pair of ids is the number of rows in which they are linked; n_best and count_sum are over the links of a row, as are the links whose count
    no other pair of their A id exceeds. A text that is NULL, empty or not given back byte by byte by both tokenizers has no tokens. Repeated
    rows count each. Memory follows the chunk, or a longer text; a word of many megabytes is encoded in one piece. ``a`` and ``b`` are
    paths of tokenizer files on the executors. The driver gathers and broadcasts two numbers for each id of A.
    """
    stored = store(parts(docs, a, b))
    vector = stored.filter("ids IS NOT NULL").select(F.explode(F.arrays_zip("ids", "ns")).alias("e")).groupBy(F.col("e.ids").alias("id")).agg(F.sum("e.ns").alias("n"))
    pairs = stored.filter("shuffled IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("shuffled", "documents")).alias("pos", "e"))
    pairs = pairs.select("chunk", "pos", F.col("e.shuffled").alias("key"), F.col("e.documents").alias("documents"))
    counts = store(pairs.groupBy("key").agg(F.sum("documents").alias("n")))
    size = len(load(a, b).identity)
    regular, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in vector.collect():
        regular[r.id] = r.n
    for r in counts.groupBy(F.shiftright("key", 32).alias("id")).agg(F.max("n").alias("n")).collect():
        best[r.id] = r.n
    known = docs.sparkSession.sparkContext.broadcast((regular, np.maximum(best, regular)))
    # both sides are plain shuffles, so that a pair which every chunk holds can be split
    pulled = pairs.select("chunk", "pos", "key").join(counts, "key").select(F.col("chunk").alias("of"), "pos", "n")

    def score(own: pa.Table, counted: pa.Table) -> pa.Table:
        own = own.combine_chunks().sort_by("place")
        word, n, pair, times, links, keys = (unpacked(own.column(c)[0].as_py()) for c in HEAD)
        word, keys, bound = np.cumsum(word), np.cumsum(keys), np.concatenate(([0], np.cumsum(links)))
        regular, best = known.value
        id_a = keys >> 32
        count = regular[id_a]
        outside = np.zeros(counted.num_rows, np.int64)
        outside[counted.column("pos").to_numpy()] = counted.column("n").to_numpy()
        count[load(a, b).identity[id_a] != (keys & 0xFFFFFFFF)] = outside
        edge = np.concatenate(([0], np.cumsum(own.column("words").to_numpy())))
        by_word = summed(times * count[pair], bound), summed(times * (count == best[id_a])[pair], bound)
        count_sum, n_best = (summed(x[word] * n, edge) for x in by_word)
        result = own.select(["doc_id", *NUMBERS]).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
        return result.append_column("groups_sha256", own.column("groups_sha256"))

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    texts = stored.filter("chunk IS NOT NULL").drop("shuffled", "documents", "ids", "ns")
    return texts.groupBy("chunk").cogroup(pulled.groupBy("of")).applyInArrow(score, schema)
