"""Removal of word windows that an earlier document has, with a count-min prefilter.

A first pass sketches the anchors of all windows; a second pass groups exactly those windows only whose anchor the
sketch takes for repeated. The sketch only ever overestimates, so no repeated window is lost.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import windows
from riskloom.llm.texts import per_slice, utf8
from riskloom.runtime import store

WINDOW = 50
GRAM = 16


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row, low, end``: word ranges covered by windows whose words also start in a document with a smaller doc_id.

    ``row`` is that of ``windows.rows_of``; ranges of a row may overlap. Anchors that serve equal windows are grouped first, which
    decides most windows at once; windows are grouped one by one only where different groups share an anchor,
    and only for the smallest doc_id of each group. Rows with a NULL doc_id neither lose words nor make others lose any.
    """
    rows = windows.rows_of(docs)
    twice = windows.sketch(rows, windows.words, window, gram)
    found = store(windows.repeated_anchors(rows, windows.words, window, gram, twice).filter("doc_id IS NOT NULL"))
    spans = store(found.groupBy("key", "s1", "s2").agg(F.min("doc_id").alias("first")))
    shared = store(spans.groupBy("key").agg(F.count(F.lit(1)).alias("spans")).filter("spans > 1").select("key"))
    placed = store(found.join(spans, ["key", "s1", "s2"]).select("key", "row", "low", "n", (F.col("doc_id") > F.col("first")).alias("later")))
    whole = placed.filter("later").select("row", "low", (F.col("low") + F.col("n") + (window - 1)).alias("end"))

    open_spans = placed.filter("NOT later").join(shared, "key", "left_semi")
    lists = store(open_spans.groupBy("row").agg(F.collect_set(F.struct("low", "n")).alias("spans")))
    single = store(windows.explode_windows(windows.with_lists(rows, lists, "inner"), windows.words, window))
    first = store(single.groupBy("w1", "w2").agg(F.min("doc_id").alias("first")))
    later = single.join(first, ["w1", "w2"]).filter(F.col("doc_id") > F.col("first"))
    return whole.unionByName(later.select("row", F.col("place").alias("low"), (F.col("place") + window).alias("end")))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each row's words without the ranges of ``spans``, joined by one blank."""
    lists = store(spans.groupBy("row").agg(F.collect_list(F.struct("low", "end")).alias("spans")))
    joined = windows.with_lists(windows.rows_of(docs), lists, "left").select("doc_id", "text", "spans")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, kept = [], [], []
        for text, found in zip(utf8(part), part.column("spans").to_pylist()):
            split = text.split()
            total.append(len(split))
            if found:
                mask = windows.covered(found, len(split))
                split = [w for w, cut in zip(split, mask.tolist()) if not cut]
            gone.append(total[-1] - len(split))
            kept.append(b" ".join(split))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

    return per_slice(joined, run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row: windows are judged on the input, not on what is left.

    NULL and empty texts have no words; texts of fewer than ``window`` words lose none. Rows that repeat a doc_id do not
    count as smaller than each other, so equal rows keep or lose the same words. Empty in, empty out.
    """
    return remove(docs, removed_spans(docs, window, gram))

