"""Language of texts and of their parts.

Ranges of scripts narrow the candidate languages of each word, letter n-grams score it for each candidate, and a
Viterbi pass with a penalty for changing the language labels the words of a text, so that spans of
mixed-language texts come out. A text is named after the language of most of its letters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import map_batches, per_slice, slices

BUCKETS = 1 << 15  # hashed n-grams, so that the model's size is bounded
SMOOTHING = 0.5
PENALTY = 6.0  # log-probability that a change of the language must gain
SCRIPT_SHARE = 0.01  # a script that has less of a language's letters does not speak for it
OFF_SCRIPT = -50.0
UNKNOWN = "und"

# First code points of script ranges (Unicode block boundaries); letters elsewhere are script 0.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "hiragana"), (0x30A0, 0x30FF, "katakana"),
    (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x2FFFF, "han"),
]
NAMES = ["other", *dict.fromkeys(s[2] for s in SCRIPTS)]


@cache
def _folded() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(len(table)):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@cache
def _script() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for lo, hi, name in SCRIPTS:
        table[lo : hi + 1] = NAMES.index(name)
    return table


@dataclass
class Words:
    """The letter runs of a slice of texts: n-gram hashes of each letter, and where words and texts begin."""

    grams: list[np.ndarray]
    letters: np.ndarray  # place of each letter in the slice, in code points
    first: np.ndarray  # index into letters of each word's first letter
    size: np.ndarray  # letters of each word
    text: np.ndarray  # text of each word
    script: np.ndarray
    bounds: np.ndarray  # place of each text in the slice


def words_of(texts: list[str]) -> Words:
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    code = np.concatenate((np.zeros(2, np.uint32), _folded()[raw], np.zeros(2, np.uint32)))
    at = np.flatnonzero(code)
    c = code[at]
    before, after = code[at - 1], code[at + 1]
    before2 = np.where(before > 0, code[at - 2], 0)
    after2 = np.where(after > 0, code[at + 2], 0)
    mix = lambda x, k: x * np.uint32(k)
    three = mix(before, 0x9E3779B1) ^ mix(c, 0x85EBCA77) ^ mix(after, 0xC2B2AE3D)
    five = three ^ mix(before2 + np.uint32(7), 0x27D4EB2F) ^ mix(after2 + np.uint32(11), 0x165667B1)
    shrink = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)
    first = np.flatnonzero(before == 0)
    place = at - 2
    return Words(
        [shrink(three), shrink(five)], place, first, np.diff(np.append(first, len(at))),
        np.searchsorted(bounds, place[first], "right") - 1, _script()[raw[place[first]]] if len(first) else np.zeros(0, np.uint8), bounds,
    )


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # log-probabilities: kind of n-gram x bucket x language
    allowed: np.ndarray  # script x language


def train(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs`` (text, lang) with a text and a language.

    Each task adds up the hashed n-grams and scripts of its texts, and the sums of all tasks, at most
    (2 * BUCKETS + scripts) per language, make the model. Without rows the model has no language.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").to_pylist()
                w = words_of(part.column("text").to_pylist())
                of_letter = np.repeat(w.text, w.size)
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs])
                for k, name in enumerate(names):
                    total = totals.setdefault(name, np.zeros(2 * BUCKETS + len(NAMES), np.int64))
                    mine = number[of_letter] == k
                    for kind, h in enumerate(w.grams):
                        total[kind * BUCKETS : (kind + 1) * BUCKETS] += np.bincount(h[mine], minlength=BUCKETS)
                    words = number[w.text] == k
                    total[2 * BUCKETS :] += np.bincount(w.script[words], weights=w.size[words], minlength=len(NAMES)).astype(np.int64)
        for name, total in totals.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * max(1, len(cells))), pa.array(cells if len(cells) else [0]), pa.array(total[cells] if len(cells) else [0])],
                names=["lang", "cell", "n"],
            )

    sums = map_batches(rows, run, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((2 * BUCKETS + len(NAMES), len(langs)))
    if langs:
        number = {x: i for i, x in enumerate(langs)}
        counts[sums.column("cell").to_numpy(), [number[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    grams = counts[: 2 * BUCKETS].reshape(2, BUCKETS, len(langs)) + SMOOTHING
    scripts = counts[2 * BUCKETS :]
    return Model(
        langs, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32),
        scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1),
    )


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Words x languages: summed log-probabilities of the letters' n-grams among the script's candidates.

    A script that no language has rules out none.
    """
    if not len(w.first):
        return np.zeros((0, len(model.langs)), np.float32)
    by_letter = model.weights[0][w.grams[0]] + model.weights[1][w.grams[1]]
    scores = np.add.reduceat(by_letter, w.first, axis=0) / 2
    allowed = model.allowed[w.script]
    return scores + np.where(allowed | ~allowed.any(1, keepdims=True), 0, OFF_SCRIPT).astype(np.float32)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word: texts of ``sizes`` words from ``starts``, all decoded side by side.

    Maximises the words' scores less ``penalty`` for each change. Ties go to staying, then to the smallest
    language number.
    """
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    if not steps:
        return labels
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts with a word at each step
    value = scores[starts[: active[0]]].astype(np.float64)
    best = np.zeros(len(scores), np.int16)  # at a word: the language of the best path up to the word before
    moved = np.zeros(scores.shape, bool)
    for t in range(1, steps):
        value = value[: active[t]]
        at = starts[: active[t]] + t
        top = value.argmax(1)
        jump = value[np.arange(len(top)), top] - penalty
        change = value < jump[:, None]
        best[at], moved[at] = top, change
        value = np.where(change, jump[:, None], value) + scores[at]
        ends = active[t + 1] if t + 1 < steps else 0
        if ends < active[t]:
            labels[at[ends:]] = value[ends:].argmax(1)
    single = active[1] if steps > 1 else 0
    labels[starts[single : active[0]]] = scores[starts[single : active[0]]].argmax(1)
    for t in range(steps - 1, 0, -1):
        at = starts[: active[t]] + t
        now = labels[at]
        labels[at - 1] = np.where(moved[at, now], best[at], now)
    return labels


def _decode(batch: pa.RecordBatch, model: Model, penalty: float) -> tuple[Words, np.ndarray, np.ndarray]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    w = words_of(texts)
    n = np.bincount(w.text, minlength=len(texts))
    starts = np.cumsum(n) - n
    filled = np.flatnonzero(n)
    return w, viterbi(word_scores(w, model), starts[filled], n[filled], penalty), n


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row: the language of most letters, and its share of the letters.

    A NULL text, a text without a letter and any text under a model without languages are ``und`` with score 0.
    Equal shares go to the language first in the alphabet.
    """
    names = [*model.langs, UNKNOWN]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not model.langs:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([UNKNOWN] * batch.num_rows), pa.array([0.0] * batch.num_rows)], names=["doc_id", "lang_pred", "score"])
        w, labels, _ = _decode(batch, model, penalty)
        share = np.zeros((batch.num_rows, len(model.langs)))
        np.add.at(share, (w.text, labels), w.size)
        total = share.sum(1)
        pred = np.where(total > 0, share.argmax(1), len(model.langs))
        score = share.max(1) / np.maximum(total, 1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([names[i] for i in pred]), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return per_slice(_texts(docs), run, "doc_id bigint, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``doc_id, spans``: the text's runs of words of one language as ``{start, end, lang}`` in code points.

    A span reaches from its first word's first letter to behind its last word's last; texts without a letter
    have an empty list.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model.langs:
            w, labels, n = _decode(batch, model, penalty)
        else:
            w, labels, n = words_of([""]), np.zeros(0, int), np.zeros(batch.num_rows, int)
        begin = w.letters[w.first] if len(w.first) else w.first
        end = begin + w.size
        new = np.ones(len(labels), bool)
        if len(labels):
            new[1:] = (labels[1:] != labels[:-1]) | (w.text[1:] != w.text[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(labels)) - 1 if len(at) else at
        shift = w.bounds[w.text[at]] if len(at) else at
        found = pa.StructArray.from_arrays(
            [pa.array(begin[at] - shift, pa.int64()), pa.array(end[last] - shift, pa.int64()), pa.array([model.langs[i] for i in labels[at]], pa.string())],
            names=["start", "end", "lang"],
        )
        per = np.bincount(w.text[at], minlength=batch.num_rows) if len(at) else np.zeros(batch.num_rows, int)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), found)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "spans"])

    return per_slice(_texts(docs), run, "doc_id bigint, spans array<struct<start: bigint, end: bigint, lang: string>>")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for the documents kept from learning; NULL ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))
