"""Repeated windows of a corpus: anchors as tables, a count-min sketch of them, and what to remove.

Shared by the removal of repeated word windows and of repeated byte strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import anchors
from riskloom.llm.texts import map_batches, per_slice, slices, utf8

SLICE = 400_000  # bytes of text whose hashes are held at a time
DEPTH, CELL_BITS, BLOCK_BITS = 2, 25, 20
CELL_FACTORS = (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)

Elements = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text begins. Words end at blanks and \\x09-\\x0D."""
    split = [t.split() for t in texts]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for ws in split for w in ws], np.uint64), np.cumsum([0, *map(len, split)])


def octets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each text begins."""
    return np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64), np.cumsum([0, *map(len, texts)])


def rows_of(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, row, text``: row is a hash of both, so that texts that share a doc_id stay apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, *(carry or []))
    return texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text", *(carry or []))


def cells(keys: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """Cell of each key in each row of the sketch, rows one after the other."""
    return [((keys * np.uint64(f)) >> np.uint64(64 - CELL_BITS)).astype(np.int64) + (i << CELL_BITS) for i, f in enumerate(CELL_FACTORS[:depth])]


def sketch(rows: DataFrame, elements: Elements, window: int, gram: int) -> Broadcast[np.ndarray]:
    """Which cells of a count-min sketch of all anchors hold two or more.

    Each task sketches its texts (counts stop at two) and sends the cells that it has touched, by blocks; blocks are
    merged in many tasks as a stream, and only their bits, DEPTH * 2**CELL_BITS in all (8 MB), go to the driver
    and the executors. A sketch that is too full for its corpus lets more through, and loses nothing.
    """
    blocks = DEPTH << (CELL_BITS - BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        touched: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            cell, n = np.unique(np.concatenate(touched), return_counts=True)
            touched.clear()
            coded = ((cell & ((1 << BLOCK_BITS) - 1)) << 1 | (n > 1)).astype("<u4")
            edges = np.searchsorted(cell, np.arange(blocks + 1) << BLOCK_BITS)
            some = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([coded[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary())], names=["block", "cells"])

        held = 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                values, bounds = elements(utf8(part))
                found = cells(anchors.find(values, bounds, window, gram).key)
                touched += found
                held += len(found[0])
                if held > 1_000_000:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                coded = np.frombuffer(raw, "<u4")
                total = counts.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
                at = coded >> 1
                total[at] = np.minimum(2, total[at] + 1 + (coded & 1))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([np.packbits(c > 1).tobytes() for c in counts.values()], pa.binary())], names=["block", "bits"])

    schema = "block int, cells binary"
    counted = map_batches(rows.select("text"), count, schema).repartition("block")
    merged = map_batches(counted, merge, "block int, bits binary").toArrow()
    bits = np.zeros((blocks, 1 << (BLOCK_BITS - 3)), np.uint8)
    for block, raw in zip(merged.column("block").to_pylist(), merged.column("bits").to_pylist()):
        bits[block] = np.frombuffer(raw, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits.ravel())


def repeated_anchors(rows: DataFrame, elements: Elements, window: int, gram: int, twice: Broadcast[np.ndarray]) -> DataFrame:
    """``key, s1, s2, doc_id, row, low, n, at``: the anchors that the sketch takes for repeated, with the windows served.

    Windows ``low`` to ``low + n - 1`` (counted in the text's elements) are served by the anchor at ``at``; s1 and s2 hash all their
    elements, so that anchors with equal hashes serve equal windows.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = elements(utf8(part))
        a = anchors.find(values, bounds, window, gram)
        keep = np.ones(len(a.key), bool)
        for cell in cells(a.key):
            keep &= (twice.value[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
        text = a.text[keep]
        base = bounds[text]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(a.key[keep].view(np.int64)), pa.array(a.span[0][keep].view(np.int64)), pa.array(a.span[1][keep].view(np.int64)),
                part.column("doc_id").take(pa.array(text)), part.column("row").take(pa.array(text)), pa.array(a.low[keep] - base),
                pa.array((a.high - a.low + 1)[keep]), pa.array(a.place[keep] - base),
            ],
            names=["key", "s1", "s2", "doc_id", "row", "low", "n", "at"],
        )

    schema = "key bigint, s1 bigint, s2 bigint, doc_id bigint, row bigint, low bigint, n bigint, at bigint"
    return per_slice(rows, run, schema, limit=SLICE)


def with_lists(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``doc_id, row, text`` joined with the stored ``lists`` (row, ..): both sides are plain shuffles."""
    return rows.join(lists, "row", how)


def explode_windows(listed: DataFrame, elements: Elements, window: int) -> DataFrame:
    """``w1, w2, doc_id, row, place``: two hashes of each window of the listed spans ``low, n`` of each text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = elements(utf8(part))
        spans = part.column("spans").to_pylist()
        text = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
        low = np.array([s["low"] for one in spans for s in one], np.int64) + bounds[text]
        n = np.array([s["n"] for one in spans for s in one], np.int64)
        starts, of = anchors.ranges(low, low + n - 1)
        hashes = anchors.window_hashes(values, starts, window)
        text = text[of]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), part.column("doc_id").take(pa.array(text)),
                part.column("row").take(pa.array(text)), pa.array(starts - bounds[text]),
            ],
            names=["w1", "w2", "doc_id", "row", "place"],
        )

    return per_slice(listed.select("doc_id", "row", "text", "spans"), run, "w1 bigint, w2 bigint, doc_id bigint, row bigint, place bigint", limit=SLICE)


def covered(spans: list[dict] | None, size: int) -> np.ndarray:
    """True for each of ``size`` elements that is in one of the spans ``low`` to before ``end``."""
    change = np.zeros(size + 1, np.int32)
    if spans:
        np.add.at(change, [s["low"] for s in spans], 1)
        np.add.at(change, [s["end"] for s in spans], -1)
    return np.cumsum(change[:-1]) > 0
