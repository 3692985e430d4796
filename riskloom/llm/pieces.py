"""Encoding and decoding with a vocabulary of scored pieces.

An Aho-Corasick automaton over all pieces reads a text once; at each position its output links give every piece
that ends there, longest first, and each relaxes the best score of that position. Characters that no
piece covers become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from functools import cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import per_slice

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MARKS = ".,;:?!)\"'"  # tried as ends of units
CACHED_UNITS = 300_000  # per Python worker; a full cache starts anew
LONG_UNIT = 100  # characters; longer units are not cached


class PieceCodec:
    """Best-scoring segmentation of texts into pieces, and back.

    ``pieces`` are (string, score) by id, with None for ids that match no text (control, unknown and byte
    pieces); ``byte_ids`` are the ids of the 256 byte pieces. Blanks are the character of ``SPACE``, and a text
    starts with one more. Among segmentations of equal score the one with the longer last piece wins, at
    each position.
    """

    def __init__(self, pieces: list[tuple[str, float] | None], byte_ids: list[int]):
        self.automaton = ahocorasick.Automaton()
        table = [b""] * len(pieces)
        for i, piece in enumerate(pieces):
            if piece and piece[0]:
                self.automaton.add_word(piece[0], (len(piece[0]), i, piece[1]))
                table[i] = piece[0].replace(SPACE, " ").encode()
        self.automaton.make_automaton()
        for b, i in enumerate(byte_ids):
            table[i] = bytes([b])
        self.byte_ids = byte_ids
        self.raw = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(t) for t in table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        known = [p for p in pieces if p and p[0]]
        self.single = {s for s, _ in known if len(s) == 1}
        self.unknown = min((score for _, score in known), default=0.0) - UNKNOWN_PENALTY
        # A text falls apart into units that no piece crosses: before blanks, if no piece has a blank after another
        # character; around line ends, if they are in no longer piece; and between a letter or digit and
        # a mark, if no piece has the two in a row.
        blank = any(re.search(f"[^{SPACE}]{SPACE}", s) for s, _ in known)
        line = any("\n" in s for s, _ in known if len(s) > 1)
        before: dict[str, set[str]] = {m: set() for m in MARKS}
        for s, _ in known:
            for c, m in zip(s, s[1:]):
                if m in before:
                    before[m].add(c)
        ends = [rf"(?<![{''.join(map(re.escape, sorted(c)))}])(?={re.escape(m)})" if c else rf"(?={re.escape(m)})" for m, c in before.items()]
        word = rf"{SPACE}*+\w++(?:{'|'.join(ends)})|"
        self.unit = re.compile(r"(?s).+" if blank or line else rf"{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.units: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of the best path through ``text`` as it stands, without a leading blank."""
        n = len(text)
        best, start, piece = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        covered = self.single.issuperset(text)
        done = 0  # positions up to here have got what they get without a piece
        for end, (size, i, score) in self.automaton.iter(text):
            if not covered:
                while done < end:
                    self._leave_out(text, done, best, start, piece)
                    done += 1
            end += 1
            s = best[end - size] + score
            if s > best[end]:
                best[end], start[end], piece[end] = s, end - size, i
        if not covered:
            while done < n:
                self._leave_out(text, done, best, start, piece)
                done += 1
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids += [self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "replace"))]
            at = start[at]
        ids.reverse()
        return ids

    def _leave_out(self, text: str, at: int, best: list, start: list, piece: list) -> None:
        """Let the character at ``at`` be no piece, if it is none by itself."""
        if text[at] not in self.single and best[at] + self.unknown > best[at + 1]:
            best[at + 1], start[at + 1], piece[at + 1] = best[at] + self.unknown, at, -1

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers; none for an empty text."""
        if not text:
            return b""
        units = self.unit.findall(SPACE + text.replace(" ", SPACE))
        if len(self.units) > CACHED_UNITS:
            self.units.clear()
        for u in set(units).difference(self.units):
            ids = self.segment(u)
            self.units[u] = pack(f"<{len(ids)}i", *ids)
        ids = b"".join(map(self.units.__getitem__, units))
        if max(map(len, units)) > LONG_UNIT:
            for u in units:
                if len(u) > LONG_UNIT:
                    self.units.pop(u, None)
        return ids

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ``ids`` without the leading blank; ids that stand for no text are left out."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(sizes.sum())
        raw = self.raw[at].tobytes()
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


@cache
def load(path: str) -> PieceCodec:
    """The codec of a SentencePiece model file with byte pieces."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    pieces = [None if special(i) else (m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    return PieceCodec(pieces, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` for each row: the ids of the whole text; NULL and empty texts have an empty list."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = load(path)
        coded = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
        offsets = np.cumsum([0, *(len(c) // 4 for c in coded)])
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_slice(texts, run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, text`` for rows of ``doc_id, ids``; a NULL list counts as empty.

    Decoding what ``encode`` made gives the text back, save that a character of ``SPACE`` comes back as a blank.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        codec, coded = load(path), part.column("ids")
        flat = coded.flatten().to_numpy().astype("<i4", copy=False)  # NULL lists have no part in it
        counts = pc.fill_null(pc.list_value_length(coded), 0).to_numpy()
        ids = np.split(flat, np.cumsum(counts)[:-1])
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array([codec.decode(x) for x in ids], pa.string()),
            ],
            names=["doc_id", "n_ids", "ids_crc32", "text"],
        )

    return per_slice(tokens.select("doc_id", "ids"), run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, text string", "ids")
