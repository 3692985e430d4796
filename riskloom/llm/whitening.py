"""Whitening of embeddings: principal components of a distributed covariance, scaled to unit variance.

Counts, sums and centred products are gathered from the tasks. The covariance, as wide as a vector, is brought to tridiagonal form by
Householder reflections at the driver; its leading eigenvalues come from bisection on Sturm counts, the components from inverse
iteration, made orthogonal within clusters of close eigenvalues. Their projection is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import map_batches
from riskloom.runtime import store

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 61  # entries are held within this, so that their sums and differences can be told exactly
CLOSE = 1e-3  # eigenvalues nearer than this share of the largest form a cluster
ROWS = 4096  # vectors that are held as doubles at a time


@dataclass
class Whitening:
    """A fitted whitening: n vectors of sums ``sums`` by dimension, components in rows, eigenvalues falling, and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def integers(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``batch`` whose ``vector`` counts, and their entries as whole numbers.

    NULL vectors and vectors with NULL or non-finite entries don't count, nor do those of another length than ``width``.
    Entries beyond about 2^51 are held at +-2^61.
    """
    vectors = batch.column("vector")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)  # NULL becomes NaN
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    rows = np.flatnonzero(np.asarray(vectors.is_valid()) & (sizes == width))
    starts = np.cumsum(sizes) - sizes
    c = flat[starts[rows][:, None] + np.arange(width)]
    fine = np.isfinite(c).all(1)
    rows, c = rows[fine], c[fine]
    with np.errstate(over="ignore"):
        return rows, np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _vectors(table: DataFrame, vector: str, *columns: str) -> DataFrame:
    return table.select(*columns, F.col(vector).cast("array<double>").alias("vector"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(a, ROWS) for a in range(0, batch.num_rows, ROWS))


def sums(table: DataFrame, vector: str = "embedding") -> tuple[int, list[int]]:
    """How many vectors count, and their exact sums by dimension.

    All have to have one length for a covariance; if they don't, those of the most frequent length count (of ties, the shortest).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in _parts(batches):
            for width in {int(w) for w in np.asarray(batch.column("vector").value_lengths().drop_null())}:
                rows, x = integers(batch, width)
                own = found.setdefault(width, [0, [0] * width])
                own[0] += len(rows)
                # halves of 32 bits, whose sums over a part fit 64 bits
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                own[1] = [s + (h << 32) + w for s, h, w in zip(own[1], high, low)]
        for width, (n, total) in found.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([width] * (width + 1), pa.int32()), pa.array(range(-1, width), pa.int32()),
                        pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0)),
                    ],
                    names=["width", "dim", "total"],
                )

    parts = map_batches(_vectors(table, vector), run, "width int, dim int, total decimal(38,0)")
    # one row per dimension, and a row -1 with the number of vectors
    totals = store(parts.groupBy("width", "dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")))
    lengths = totals.filter("dim = -1").orderBy(F.desc("total"), "width").limit(1).collect()
    if not lengths:
        return 0, []
    rows = totals.filter(F.col("width") == lengths[0].width).orderBy("dim").collect()
    return int(rows[0].total), [int(r.total) for r in rows[1:]]


def deviations(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, list[int]]:
    """n*x - S as doubles, each rounded once, and for each row the exact sum of its squares."""
    base = [s // n for s in total]
    reach = max((int(abs(int(x[:, j].max()) - b)) + int(abs(int(x[:, j].min()) - b)) for j, b in enumerate(base)), default=0) if len(x) else 0
    if n * (reach + 1) < 1 << 48 and len(total) < 1 << 14:
        # sums over the dimensions of products of halves of 24 bits fit 64 bits
        d = n * (x - np.array(base, np.int64)) - np.array([s % n for s in total], np.int64)
        high, low = d >> 24, d & ((1 << 24) - 1)
        squares = zip((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())
        return d.astype(float), [(h << 48) + (m << 25) + w for h, m, w in squares]
    exact = x.astype(object) * n - np.array(total, object)
    return exact.astype(float), (exact * exact).sum(1).tolist()


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return deviations(x, n, total)[0] / n


def _moments(table: DataFrame, vector: str, width: int, change: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, centred products (summed) and number of the rows of ``change`` (size columns) over all vectors that count.

    Each task centres its rows at its own mean and merges (n, mean, products) pairwise; the tasks' rows are merged by row of the product in
    as many tasks as there are dimensions.
    """

    def merge(n, mean, m, n2, mean2, m2):
        both, step = n + n2, mean2 - mean
        return both, mean + step * (n2 / both), m + m2 + np.outer(step, step) * (n * n2 / both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in _parts(batches):
            y = change(integers(batch, width)[1])
            if len(y):
                mean = y.mean(0)
                own = (len(y), mean, (y - mean).T @ (y - mean))
                have = merge(*have, *own) if have else own
        if have:
            n, mean, m = have
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([mean.tolist()] * size), pa.array(m.tolist())], names=["i", "n", "mean", "row"]
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, tuple] = {}
        for batch in batches:
            for i, n2, mean2, row2 in zip(*(batch.column(c).to_pylist() for c in ("i", "n", "mean", "row"))):
                mean2, row2 = np.array(mean2), np.array(row2)
                if i in have:
                    n, mean, row = have[i]
                    step, both = mean2 - mean, n + n2
                    have[i] = both, mean + step * (n2 / both), row + row2 + step[i] * step * (n * n2 / both)
                else:
                    have[i] = n2, mean2, row2
        if have:
            n, mean, row = zip(*have.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array(n, pa.int64()), pa.array([v.tolist() for v in mean]), pa.array([v.tolist() for v in row])], names=["i", "n", "mean", "row"])

    schema = "i int, n bigint, mean array<double>, row array<double>"
    merged = map_batches(map_batches(_vectors(table, vector), run, schema).repartition("i"), join, schema)
    rows = sorted(merged.collect(), key=lambda r: r.i)
    return np.array(rows[0].mean), np.array([r.row for r in rows]), rows[0].n


def fit(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The leading components of all vectors of ``table`` that count (see ``integers``, ``sums``); repeated rows count each.

    Components whose eigenvalue is not above rounding (no more than 2^-40 of the largest) are left out: there are fewer than asked for with few
    or equal vectors, and none for an empty table. The driver holds a few matrices as wide as a vector.
    """
    n, total = sums(table, vector)
    width = len(total)
    if not width:
        return Whitening(n, total, np.zeros((0, 0)), np.zeros(0), 0.0)
    _, products, seen = _moments(table, vector, width, lambda x: centred(x, n, total), width)
    assert seen == n
    covariance = (products + products.T) / (2 * n)
    values, vectors = leading(covariance, min(components, width))
    some = values > (values[0] if len(values) else 0) * 2.0**-40
    return Whitening(n, total, vectors[some], values[some], float(np.trace(covariance)))


def whiten(table: DataFrame, model: Whitening, name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``name, component, deviation, whitened``: a row for each vector that counts and each component.

    deviation is the exact sum of squares of n*x - S over the dimensions, as decimal(38,0), NULL where it has more digits.
    """
    width, k = len(model.sums), len(model.values)
    kind = table.schema[name].dataType.simpleString()
    scaled = (model.components / np.sqrt(model.values)[:, None]).T if k else np.zeros((width, 0))
    names = [name, "component", "deviation", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows, x = integers(batch, width)
            if len(rows):
                d, squares = deviations(x, model.n, model.sums)
                exact = pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(name).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        exact.take(each), pa.array((d / model.n @ scaled).ravel()),
                    ],
                    names=names,
                )

    source = table if k else table.limit(0)
    return map_batches(_vectors(source, vector, name), run, f"`{name}` {kind}, component int, deviation decimal(38,0), whitened double")


def identity_error(table: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened vectors of ``table`` minus the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0
    scaled = (model.components / np.sqrt(model.values)[:, None]).T
    _, products, n = _moments(table, vector, len(model.sums), lambda x: centred(x, model.n, model.sums) @ scaled, k)
    return float(np.abs(products / n - np.eye(k)).max())


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors in rows."""
    scale = float(np.abs(matrix).max(initial=0))
    if not scale:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diagonal, beside, reflections = tridiagonal(matrix / scale)
    values = bisected(diagonal, beside, k)
    vectors = inverse_iterated(diagonal, beside, values)
    for at, v in reversed(reflections):
        vectors[:, at:] -= 2 * np.outer(vectors[:, at:] @ v, v)
    return values * scale, vectors


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, side diagonal, and the Householder reflections ``(first row, unit vector)`` that lead there."""
    a, reflections = matrix.copy(), []
    for j in range(len(a) - 2):
        v = a[j + 1 :, j].copy()
        length = float(np.linalg.norm(v))
        if not length or not np.abs(v[1:]).max():
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = a[j + 1 :, j + 1 :]
        p = rest @ v
        w = 2 * p - 2 * (v @ p) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[j + 1 :, j] -= 2 * v * (v @ a[j + 1 :, j])
        reflections.append((j + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def count_below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each of ``at``: the negative pivots (Sturm's sequence)."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    below, pivot = np.zeros(len(at), int), np.ones(len(at))
    for d, e in zip(diagonal, [0.0, *beside]):
        pivot = d - at - e * e / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def bisected(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, each by bisection down to neighbouring doubles."""
    n = len(diagonal)
    around = np.abs(np.append(beside, 0)) + np.abs(np.append(0, beside))
    width = float(np.abs(diagonal).max() + around.max())
    low, high = np.full(k, -2 * width - 1e-300), np.full(k, 2 * width + 1e-300)
    rank = n - np.arange(k)  # the eigenvalue with this many at or below it
    for _ in range(1100):
        middle = (low + high) / 2
        if not ((low < middle) & (middle < high) & (high - low > np.finfo(float).eps * width * 0.25)).any():
            break
        under = count_below(diagonal, beside, middle) >= rank
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return (low + high) / 2


def solved(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """The solution of (T - shift) y = right by elimination with row exchanges; pivots of zero become tiny."""
    n = len(diagonal)
    d, u, w, y = (diagonal - shift).tolist(), [*beside.tolist(), 0.0], [0.0] * n, right.tolist()
    least = np.finfo(float).eps * (float(np.abs(diagonal).max()) + float(np.abs(beside).max(initial=0)) + abs(shift))
    for i in range(n - 1):
        e = float(beside[i])
        if abs(e) > abs(d[i]):
            # rows (d u w) and (e d' u') change places
            f = d[i] / e
            d[i], d[i + 1], u[i], w[i], u[i + 1] = e, u[i] - f * d[i + 1], d[i + 1], u[i + 1], -f * u[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > least else math.copysign(least, d[i])
            f = e / d[i]
            d[i + 1] -= f * u[i]
            y[i + 1] -= f * y[i]
    for i in reversed(range(n)):
        pivot = d[i] if abs(d[i]) > least else math.copysign(least, d[i])
        y[i] = (y[i] - (u[i] * y[i + 1] if i + 1 < n else 0.0) - (w[i] * y[i + 2] if i + 2 < n else 0.0)) / pivot
    return np.array(y)


def inverse_iterated(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors in rows for the eigenvalues ``values`` (falling) of a tridiagonal matrix.

    Each is made orthogonal to those of its cluster in every round; equal shifts are set apart by rounding.
    """
    n = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(beside).max(initial=0))
    rng = np.random.default_rng(17)
    vectors, first, shift = np.zeros((len(values), n)), 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            first = j
        shift = min(float(value), shift - 10 * np.finfo(float).eps * norm) if j > first else float(value)
        y = rng.standard_normal(n)
        for _ in range(rounds):
            y = solved(diagonal, beside, shift, y / np.linalg.norm(y))
            near = vectors[first:j]
            for _ in range(2):
                y = y - near.T @ (near @ y)
        vectors[j] = y / np.linalg.norm(y)
    return vectors
