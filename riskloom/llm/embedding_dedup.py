"""Near-duplicate embeddings, found in the leaves of a forest of random-projection trees.

Each tree splits space at medians of random projections, again and again; vectors near a split go to both
sides. Vectors are compared within leaves, every pair found is verified in double precision, and the
links are united. The trees are fitted on a bounded sample; every vector is indexed and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from riskloom.llm.components import connected_components
from riskloom.llm.texts import map_batches
from riskloom.runtime import store

THRESHOLD = 0.93
TREES = 8
SPILL = 0.02  # half-width of the zone around a split, in units of length 1, from which both sides get a vector
LEAF = 2_000  # vectors that a leaf should hold, all labels together
SAMPLE = 50_000  # expected bound of the vectors on which the splits are fitted
BLOCK = 1_024  # rows of a leaf and label that are compared at once; larger ones go in pairs of blocks
SEED = 11


class Tree:
    """A split of the unit sphere: inner nodes with a direction and a median, leaves with a number."""

    def __init__(self, x: np.ndarray, leaf_rows: float, spill: float, rng: np.random.Generator):
        self.spill, self.directions, self.medians, self.children = spill, [], [], []
        self.leaves = 0
        self.root = self._grow(x, leaf_rows, rng)

    def _grow(self, x: np.ndarray, leaf_rows: float, rng: np.random.Generator) -> int:
        """Node number, or -1 - leaf number."""
        if len(x) > max(leaf_rows, 8):
            d = rng.standard_normal(x.shape[1])
            d /= np.linalg.norm(d)
            p = x @ d
            m = float(np.median(p))
            low, high = p < m, p >= m
            if low.any() and high.any():
                node = len(self.directions)
                self.directions.append(d)
                self.medians.append(m)
                self.children.append((0, 0))
                # the sample is split without spilling, so that its size tells the depth
                self.children[node] = (self._grow(x[low], leaf_rows, rng), self._grow(x[high], leaf_rows, rng))
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaf numbers with the rows that reach them."""
        waiting = [(self.root, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            p = x[rows] @ self.directions[node] - self.medians[node]
            waiting.append((self.children[node][0], rows[p < self.spill]))
            waiting.append((self.children[node][1], rows[p >= -self.spill]))


def unit(rows: list | np.ndarray, dim: int | None = None) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by way of their largest component."""
    x = np.array(rows, np.float64).reshape(len(rows), -1 if dim is None else dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_forest(x: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> list[Tree]:
    """Trees over the sample ``x`` so deep that leaves hold about ``leaf`` of ``rows`` vectors (before spilling)."""
    rng = np.random.default_rng(SEED)
    return [Tree(x, leaf * len(x) / max(rows, 1), spill, rng) for _ in range(trees)]


def _kind(vectors: DataFrame) -> str:
    """The type that vectors are sent in: float if that is what they are, else double. They are compared in double precision."""
    kind = vectors.schema["embedding"].dataType
    return "float" if getattr(kind, "elementType", None) == FloatType() else "double"


def _classes(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, k1, k2``: equal vectors of a label share the keys; NULL keys for vectors that link with nothing."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), v.cast(f"array<{_kind(vectors)}>").alias("embedding"),
        F.when(usable, F.xxhash64(v)).alias("k1"), F.when(usable, F.xxhash64(F.lit(1), v)).alias("k2"),
    )


def _place(classes: DataFrame, forest: list[Tree], dim: int) -> DataFrame:
    """One row per vector and leaf: ``label, dim, leaf, node, copies, embedding, leaves`` (all leaves of the vector)."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)
    kind = "<f4" if _kind(classes) == "float" else "<f8"
    schema = "label string, dim int, leaf int, node bigint, copies bigint, embedding binary, leaves array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pa.Table.from_batches([batch]).to_pandas()
            for size, part in frame.groupby("dim"):
                x = unit(part["embedding"].tolist())
                at, leaf = [], []
                if size == dim:
                    first = 0
                    for tree in shared.value:
                        for number, rows in tree.route(x):
                            at.append(rows)
                            leaf.append(np.full(len(rows), first + number))
                        first += tree.leaves
                else:  # another length than the forest's: one leaf, compared in blocks
                    at, leaf = [np.arange(len(x))], [np.full(len(x), -1)]
                at, leaf = np.concatenate(at), np.concatenate(leaf)
                order = np.lexsort((leaf, at))
                at, leaf = at[order], leaf[order]
                lists = np.split(leaf, np.cumsum(np.bincount(at, minlength=len(x)))[:-1])
                raw = [np.asarray(v, kind).tobytes() for v in part["embedding"]]
                out = pd.DataFrame({
                    "label": part["label"].to_numpy()[at], "dim": np.int32(size), "leaf": leaf.astype(np.int32), "node": part["node"].to_numpy()[at],
                    "copies": part["copies"].to_numpy()[at], "embedding": [raw[i] for i in at], "leaves": [lists[i] for i in at],
                })
                yield from pa.Table.from_pandas(out, pa.schema([
                    ("label", pa.string()), ("dim", pa.int32()), ("leaf", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()),
                    ("embedding", pa.binary()), ("leaves", pa.list_(pa.int32())),
                ]), preserve_index=False).to_batches()

    return map_batches(classes, run, schema)


def _earlier(leaves: list, leaf: int, columns: dict[int, int]) -> np.ndarray:
    """Rows x leaves before ``leaf``: 1 where the row is in that leaf too."""
    out = np.zeros((len(leaves), len(columns)), np.float32)
    for i, row in enumerate(leaves):
        out[i, [columns[x] for x in row if x < leaf]] = 1
    return out


def _compare(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of one leaf and label, or of two blocks of it.

        A pair that meets in several leaves is counted in the first of them only. For the components
        each row names the smallest node that it reaches within the frame.
        """
        leaf, left, right = int(frame["leaf"].iat[0]), int(frame["low"].iat[0]), int(frame["high"].iat[0])
        frame = frame.sort_values("node", kind="stable")
        raw = b"".join(frame["embedding"])
        kind = "<f4" if len(raw) == 4 * len(frame) * int(frame["dim"].iat[0]) else "<f8"
        x = unit(np.frombuffer(raw, kind).reshape(len(frame), -1))
        node, copies, block = frame["node"].to_numpy(), frame["copies"].to_numpy(), frame["block"].to_numpy()
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if left != right:  # pairs within one block have a frame of their own
            linked &= block[:, None] != block[None, :]
        some = linked.any(1)
        if not some.any():
            return pd.DataFrame({"node": [], "links": [], "other": []})
        linked, node, copies = linked[np.ix_(some, some)], node[some], copies[some]
        lists = [row for row, s in zip(frame["leaves"], some) if s]
        columns = {x: i for i, x in enumerate(sorted({x for row in lists for x in row if x < leaf}))}
        met = _earlier(lists, leaf, columns)
        first = linked & ~(met @ met.T > 0)
        lowest = np.arange(len(node))
        while True:
            reached = np.minimum(lowest, np.where(linked, lowest[None, :], len(node)).min(1))
            reached = reached[reached]
            if (reached == lowest).all():
                break
            lowest = reached
        return pd.DataFrame({"node": node, "links": first @ copies, "other": node[lowest]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id`` for each row of ``vectors`` (vec_id, embedding, label).

    Two rows link if their labels are equal and not NULL and their cosine is at least ``threshold``; links of
    vectors that never share a leaf are missed, all others are exact. n_links counts the other rows linked
    directly; component_id is the smallest vec_id reachable. NULL or zero vectors, and those with NULL, NaN or
    infinite components, link with nothing. Vectors of different lengths never link. Equal vectors of a label
    are compared once. A row with a NULL vec_id counts as a link of others, and its component is named by other rows'
    ids, or NULL. Empty in, empty out.
    """
    keyed = store(_classes(vectors))
    classes = store(
        keyed.filter("k1 IS NOT NULL").groupBy("label", "k1", "k2")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .select("*", F.xxhash64("label", "k1", "k2").alias("node"), F.size("embedding").alias("dim"))
    )
    n = classes.count()
    cells = 1 << 20
    chosen = classes.filter(F.pmod("k2", F.lit(cells)) < int(cells * min(1.0, sample / max(n, 1)))).select("embedding", "dim").toArrow()
    sizes = chosen.column("dim").to_numpy()
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    rows = [v for v, d in zip(chosen.column("embedding").to_pylist(), sizes) if d == dim]
    forest = fit_forest(unit(rows, dim), n, trees, leaf, spill) if rows else []
    placed = store(_place(classes.select("label", "dim", "node", "copies", "embedding"), forest, dim))

    group = ["label", "dim", "leaf"]
    counts = store(placed.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).select("*", F.ceil(F.col("rows") / block).cast("int").alias("blocks")).drop("rows"))
    own = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high")))
    dealt = placed.join(counts, group).withColumn("block", own).withColumn("pair", F.explode(pairs)).select("*", "pair.low", "pair.high").drop("pair", "blocks")
    found = store(dealt.groupBy(*group, "low", "high").applyInPandas(_compare(threshold), "node bigint, links bigint, other bigint"))

    links = store(found.groupBy("node").agg(F.sum("links").alias("links")))
    parts = store(connected_components(found.filter("node <> other"), "node", "other").withColumnRenamed("node", "part_node"))
    named = classes.select("label", "k1", "k2", "node", "first", "copies")
    named = store(
        named.join(links, "node", "left").join(parts, F.col("node") == F.col("part_node"), "left")
        .select("label", "k1", "k2", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    smallest = store(named.groupBy("component").agg(F.min("first").alias("component_id")))
    labels = store(named.join(smallest, "component").select("label", "k1", "k2", "n_links", "component_id"))
    joined = keyed.select("vec_id", "label", "k1", "k2").join(labels, ["label", "k1", "k2"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
