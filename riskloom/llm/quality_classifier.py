"""Quality classifier learned from trusted positives and unlabelled web text.

Positive-unlabelled learning: a linear model minimises the non-negative unbiased risk, in which the
loss on negatives is what the unlabelled texts have beyond the share that positives must have of it. The
class prior is estimated from the same two samples; negative labels are not needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import fields, per_slice, utf8

HASHED = 512  # hashed byte trigrams
SAMPLE = 8_000  # expected bound of the positives, and of the unlabelled texts, that the model is fitted on
DENSE = 15
WIDTH = DENSE + HASHED
THRESHOLD = 0.3
LEAST_TAIL = 0.6  # share of the held-back positives in the sets of rows that the prior is read off

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_=+\\/{}[]", np.uint8)
_STOPS = np.frombuffer(b".,;:?!", np.uint8)


def features(text: bytes) -> np.ndarray:
    """Shape of a whole text: shares of characters, words, lines, repeats, and hashed byte trigrams."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if not n:
        return out
    seen = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split(b"\n")
    m = len(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    letters = seen[_UPPER].sum() + seen[_LOWER].sum() + seen[128:].sum()
    filled = [x for x in lines if x.strip()]
    out[:DENSE] = (
        1.0, np.log1p(n) / 10, np.log1p(m) / 10, (n - seen[32] - seen[9:14].sum()) / max(m, 1) / 10,
        seen[_UPPER].sum() / max(letters, 1), letters / n, seen[_DIGIT].sum() / n, seen[_SYMBOLS].sum() / max(m, 1),
        seen[_STOPS].sum() / max(m, 1), seen[33] / max(m, 1), len(set(words)) / max(m, 1) ** 0.9, repeats / max(m, 1),
        len(filled) / max(m, 1), 1 - len(set(filled)) / max(len(filled), 1), max(map(len, words), default=0) / 100,
    )
    if n > 2:
        a, b, c = raw[:-2].astype(np.uint32), raw[1:-1].astype(np.uint32), raw[2:].astype(np.uint32)
        mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
        out[DENSE:] = np.sqrt(np.bincount(mixed * np.uint32(0x27D4EB2F) >> np.uint32(23), minlength=HASHED) / (n - 2))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of label 1 for rows of features."""
        z = ((x - self.mean) / self.scale) @ self.weights + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Minimise prior * R(p, +) + max(0, R(u, -) - prior * R(p, -)) with the logistic loss.

    Where the second part is negative, a step that raises it again is taken instead (the correction
    of the non-negative estimator). Without positives or without unlabelled rows the weights stay zero and
    every text scores the prior.
    """
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, WIDTH), np.float32)
    mean, scale = both.mean(0), both.std(0)
    mean[0], scale = 0, np.where(scale > 1e-6, scale, 1).astype(np.float32)
    model = Model(mean, scale, np.zeros(both.shape[1], np.float32), prior)
    if not len(positive) or not len(unlabelled):
        return model
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    offset = np.log(prior / (1 - prior))
    first, second = np.zeros_like(model.weights), np.zeros_like(model.weights)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ model.weights + offset, u @ model.weights + offset
        gp_pos = -(p.T @ (1 - sigmoid(zp))) / len(p)  # of R(p, +)
        g_neg = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        negative = _softplus(zu).mean() - prior * _softplus(zp).mean()
        grad = (prior * gp_pos + g_neg if negative >= 0 else -g_neg) + decay * model.weights
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        step = (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        model.weights = (model.weights - rate * step).astype(np.float32)
    return model


def mixture_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = LEAST_TAIL, rounds: int = 2) -> float:
    """The share of positives among the unlabelled rows, estimated without negatives.

    A model of half of each tells the other halves apart. In any set of rows, the unlabelled share is at least the prior times the share of
    the positives, so that the prior is at most their ratio; of the sets of rows that score highest, with ``least`` of the positives or more, the smallest ratio is
    taken, each share moved by half its standard error against the noise of a minimum. The model is then fitted with that prior, and
    the prior read off again. Without positives or unlabelled rows it is one half.
    """
    half = [(x[::2], x[1::2]) for x in (positive, unlabelled)]
    found = 0.5
    if min(len(h) for own in half for h in own) == 0:
        return found
    error = lambda share, n: 0.5 * np.sqrt(share * (1 - share) / n)
    for _ in range(rounds):
        model = fit_nnpu(half[0][0], half[1][0], found)
        p, u = np.sort(model.score(half[0][1])), np.sort(model.score(half[1][1]))
        above_p = 1 - np.arange(len(p)) / len(p)  # share of the positives at or above each of their scores
        above_u = 1 - np.searchsorted(u, p) / len(u)
        some = above_p >= least
        ratio = (above_u + error(above_u, len(u))) / np.maximum(above_p - error(above_p, len(p)), 1e-9)
        found = float(np.clip(ratio[some].min(), 0.01, 0.99))
    return found


def labelled_prior(labelled: DataFrame) -> float:
    """Share of label 1 among the labelled rows ``quality``, drawn to one half by one row of each; NULLs do not count.

    For labels of both kinds that are drawn like the texts.
    """
    row = labelled.agg(F.count("quality").alias("n"), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1)), F.lit(0)).alias("ones")).first()
    return (row.ones + 1) / (row.n + 2)


def _share(rows: int, bound: int, salt: int) -> Column:
    """True for a share of the doc_ids, chosen by hash, that leaves about ``bound`` of ``rows``."""
    cells = 1 << 20
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(cells)) < int(cells * min(1.0, bound / max(rows, 1)))


def _matrix(texts: DataFrame) -> np.ndarray:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t).tobytes() for t in utf8(batch)]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    rows = per_slice(texts.select(F.col("text").cast("string").alias("text")), run, "x binary").toArrow().column("x")
    return np.frombuffer(b"".join(rows.to_pylist()), np.float32).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float | None = None) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), both already limited to training rows.

    Positives are texts labelled 1, the unlabelled are any texts; labels of 0 are not used. The share of positives among the texts is ``prior``, or
    estimated from these two (``mixture_prior``). Of each about ``sample`` are taken, by a hash
    of doc_id; only their features reach the driver (``sample`` rows of ``WIDTH`` floats). Labels of other
    values, NULL labels and NULL doc_ids are ignored; a doc_id labelled twice counts twice.
    """
    ones = labels.filter("doc_id IS NOT NULL AND quality = 1").select("doc_id")
    n_ones, n_docs = ones.count(), docs.count()
    texts = docs.select("doc_id", "text")
    chosen = _share(n_ones, sample, 1)
    positive = _matrix(texts.filter(chosen).join(ones.filter(chosen), "doc_id"))
    unlabelled = _matrix(texts.filter(_share(n_docs, sample, 2)))
    return fit_nnpu(positive, unlabelled, mixture_prior(positive, unlabelled) if prior is None else prior)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, score`` for each row, and the columns named in ``carry``.

    NULL and empty texts are scored as texts without any character.
    """
    carry = carry or []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([features(t) for t in utf8(batch)])
        scores = pa.array(model.score(x).astype(np.float64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), scores, *map(batch.column, carry)], names=["doc_id", "score", *carry])

    others = [c for c in carry if c != "text"]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
    return per_slice(texts, run, fields(texts, carry, "doc_id bigint, score double"))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """True for the documents kept from learning: crc32 of the id as text leaves ``fold``. NULL ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))
