"""SimHash near-duplicates found with pivot distance tables.

Fingerprints are compared by their Hamming distances to many reference fingerprints. Two fingerprints
that differ in r bits differ by at most r in their distance to any reference, so that a table of
distances discards most pairs before the fingerprints themselves are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.components import connected_components, sized, store_marked
from riskloom.llm.texts import fields, per_slice, unclashing, utf8
from riskloom.runtime import store

SHINGLE, SEED, RADIUS = 3, 42, 2
PER_BLOCK = 12  # references per block of bits; their distances, below 32 each, fill one long
BUCKET = 256  # fingerprints of a bucket that are compared in pairs; larger ones go by shared neighbours

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z in lower case; 0 without a word."""
    words = text.lower().split()  # bytes: only A-Z change, and only blanks and \\x09-\\x0D separate
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - SHINGLE] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    lanes = np.array(hashes, np.dtype("<u8")).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) for each row, and the columns in ``carry``; a NULL text counts as empty."""
    carry = carry or []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([fingerprint(t) for t in utf8(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), fps, *map(batch.column, carry)], names=["doc_id", "fp", *carry])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return per_slice(texts, run, fields(texts, carry, "doc_id bigint, fp bigint"))


def references(radius: int = RADIUS, per_block: int = PER_BLOCK) -> list[list[int]]:
    """Reference fingerprints: for each of ``radius`` + 1 blocks of bits, patterns within that block.

    Together with the zero reference they tell how many bits of a pattern a fingerprint shares:
    (d(x, 0) + weight - d(x, pattern)) / 2, which only bits of the block can change.
    """
    rng = np.random.default_rng(SEED)
    edges = np.linspace(0, 64, radius + 2).astype(int)
    patterns = []
    for lo, hi in zip(edges, edges[1:]):
        width = int(hi - lo)
        patterns.append([sum(1 << (int(lo) + int(b)) for b in rng.choice(width, width // 2, replace=False)) for _ in range(per_block)])
    return patterns


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: DataFrame, radius: int = RADIUS, per_block: int = PER_BLOCK) -> DataFrame:
    """``fp`` with ``d0, d1, ..``: per block its distance coordinates, five bits each in one long."""
    columns = []
    for g, block in enumerate(references(radius, per_block)):
        packed = F.lit(0).cast("bigint")
        for j, pattern in enumerate(block):
            ref, weight = F.lit(_signed(pattern)).cast("bigint"), pattern.bit_count()
            to_zero, to_ref = F.bit_count("fp"), F.bit_count(F.col("fp").bitwiseXOR(ref))
            shared = F.shiftright(to_zero + F.lit(weight) - to_ref, 1).cast("bigint")
            packed = packed.bitwiseOR(F.shiftleft(shared, 5 * j))
        columns.append(packed.alias(f"d{g}"))
    return fps.select("fp", *columns)


def linked(fps: DataFrame, rows: int, radius: int = RADIUS, per_block: int = PER_BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect exactly the distinct fingerprints ``fp`` (about ``rows``) at ``radius`` (1 or 2) or fewer bits.

    Of radius + 1 blocks, one is free of differing bits, so linked fingerprints agree in all distances
    to the references of some block: pairs are looked for among those. A pair whose largest
    coordinate difference anywhere exceeds the radius is discarded, the rest is verified. Where more than
    ``bucket`` fingerprints agree, no pairs are made: each goes to itself and the 64 points at one bit, and two
    are within two bits exactly if they meet at a point, where all link to the smallest.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    table = store(sized(pivot_table(fps, radius, per_block), rows))
    names = [f"d{g}" for g in range(radius + 1)]
    keyed = table.select("*", F.posexplode(F.array(*names)).alias("g", "key"))
    sizes = store(sized(keyed.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), 3 * rows))
    keyed = store(sized(keyed.join(sizes, ["g", "key"]), 3 * rows))
    small, large = keyed.filter(F.col("n") <= bucket), keyed.filter(F.col("n") > bucket)
    other = small.select("g", "key", F.col("fp").alias("other"), *[F.col(c).alias(f"o{c}") for c in names])
    lanes = f"sequence(0, {5 * (per_block - 1)}, 5)"
    near = " AND ".join(
        f"forall({lanes}, s -> abs((shiftright({c}, s) & 31) - (shiftright(o{c}, s) & 31)) <= {radius})" for c in names
    )
    pairs = (
        small.join(other, ["g", "key"])
        .filter(F.col("fp") < F.col("other"))
        .filter(F.expr(near))
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    one_bit = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)).cast("bigint") for b in range(64)])
    points = large.select("fp").distinct().select(F.col("fp").alias("a"), F.explode(F.transform(one_bit, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    if radius == 1:  # at radius 1 only fingerprints are meeting points, of themselves and of their neighbours
        points = points.join(fps.select(F.col("fp").alias("point")), "point", "left_semi")
    met = points.withColumn("b", F.min("a").over(Window.partitionBy("point")))  # at most 65 meet at a point
    if radius == 1:
        met = met.withColumn("b", F.col("point"))
    return pairs.unionByName(met.filter("a <> b").select("a", "b").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, fp, group, component_id`` for each row, and the columns in ``carry``.

    component_id is the smallest doc_id reachable over links, group the smallest fingerprint.

    Equal fingerprints are one point of the search, whatever their number. NULL and empty texts have
    fingerprint zero and link like any other. Repeated rows share a component; a NULL doc_id gets its
    component but never names one (a component of such rows only has a NULL id). Empty in, empty out.
    """
    unclashing(list(carry or []), ["doc_id", "fp", "group", "component_id"])
    marked = store(fingerprints(docs, carry))
    classes, n, _ = store_marked(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = store(sized(connected_components(linked(classes.select("fp"), n, radius)), n))
    joined = classes.join(nodes, classes["fp"] == nodes["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    joined = store(sized(joined, n))
    named = store(sized(joined.groupBy("component").agg(F.min("first").alias("component_id")), n))
    labels = store(sized(joined.join(named, "component").select("fp", F.col("component").alias("group"), "component_id"), n))
    return marked.join(labels, "fp").select("doc_id", "fp", "group", "component_id", *(carry or []))
