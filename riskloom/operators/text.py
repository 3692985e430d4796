"""From lexer tokens to weighted file vectors.

Word tables are kept long, one row per (file, word) with its count, so that a word found in most
files collapses before every shuffle and no file's words are held in one group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from riskloom.functions import columns as C
from riskloom.functions.stopwords import ENGLISH
from riskloom.operators import krylov
from riskloom.operators.ordering import running_totals
from riskloom.runtime import new_path, settle, shuffled, small_side, store, store_at, store_counted

KEPT_TYPES = ["Comment", "Identifier"]
CHUNK_ROWS, LEAST_ROWS = 4_000_000, 20_000  # (file, word) rows of a chunk of files; chunks are smaller only to use all cores
SLICE_ROWS = 50_000  # rows whose vectors are added up at a time


def keep_tokens(tokens: DataFrame, skip_rows: int = 2) -> DataFrame:
    """Comment and identifier tokens; the first ``skip_rows`` rows of a file are never read."""
    return tokens.filter((F.col("pos") >= skip_rows) & F.col("token_type").isin(KEPT_TYPES))


def clean_words(
    text: Column, stop_words: Sequence[str] = ENGLISH, split_identifiers: bool = False
) -> Column:
    """Cleaned words of a text as an array.

    Letters only, stop words out (compared before lower-casing, so ``The`` stays), words of two
    letters or more, in lower case. ``split_identifiers`` cuts the words at case boundaries
    before they are lower-cased.
    """
    words = F.split(F.trim(F.regexp_replace(text, "[^a-zA-Z]+", " ")), " ")
    words = F.filter(words, lambda w: ~w.isin(list(stop_words)) & (F.length(w) > 1))
    if split_identifiers:
        words = F.flatten(F.transform(words, C.split_identifier))
    return F.transform(words, F.lower)


def documents(tokens: DataFrame, skip_rows: int = 2, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """Words per file with their counts, ``file_id, word, tf``, from lexer tokens."""
    kept = keep_tokens(tokens, skip_rows)
    return count_words(kept.select("file_id", F.explode(clean_words(F.col("text"), stop_words)).alias("word")))


def text_words(
    texts: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = ENGLISH,
    split_identifiers: bool = False,
) -> DataFrame:
    """Words per file with their counts from whole texts."""
    words = clean_words(F.col(text_col), stop_words, split_identifiers)
    return count_words(texts.select(F.col(id_col).alias("file_id"), F.explode(words).alias("word")))


def count_words(words: DataFrame) -> DataFrame:
    return words.groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("tf"))


def idf(tf: DataFrame, n_files: Column) -> DataFrame:
    """``ln(N / (1 + df))`` per word; may be zero or negative. ``n_files`` counts empty files too."""
    return tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select(
        "word", "df", F.ln(n_files / (1 + F.col("df"))).alias("idf")
    )


def doc_vectors(
    tf: DataFrame, vectors: DataFrame, dim: int, files: DataFrame, weights: DataFrame | None = None,
    n_files: Column | None = None,
) -> DataFrame:
    """Mean of the word vectors of a file over the occurrences of known words.

    With ``weights`` (``word, idf``) each occurrence is multiplied by its weight, and the sum
    is still divided by the number of occurrences. A word without a weight gets ln N. A file
    without known words gets a zero vector and ``known = 0``.

    Files lie in chunks of about ``CHUNK_ROWS`` rows of ``tf``; a word's vector is sent once to each chunk that holds the word, and is weighted and
    added up there, so that neither a vector for each row nor partial sums of a file are shuffled.
    """
    known = vectors.select(F.col("token").alias("word"), F.array(*[F.col("vec")[i].cast("double") for i in range(dim)]).alias("vec"))
    if weights is not None:
        default = F.ln(n_files) if n_files is not None else F.lit(0.0)
        known = known.join(shuffled(weights.select("word", "idf")), "word", "left").withColumn("weight", F.coalesce("idf", default)).drop("idf")
    else:
        known = known.withColumn("weight", F.lit(1.0))
    counts = tf.filter("file_id IS NOT NULL AND word IS NOT NULL AND tf IS NOT NULL").select("file_id", "word", F.col("tf").cast("bigint").alias("tf"))
    sums = _chunk_sums(counts, known, dim)
    mean = F.transform("sums", lambda s: s / F.col("known"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return files.select("file_id").join(sums, "file_id", "left").select(
        "file_id",
        F.coalesce("known", F.lit(0)).cast("bigint").alias("known"),
        F.when(F.col("known").isNull(), zero).otherwise(mean).alias("vec"),
    )


def _chunk_sums(counts: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``file_id, known, sums``: occurrences of known words of a file, and the sums of their ``vectors`` (word, vec of ``dim``, weight).

    Vectors of single precision are sent as such.
    """
    n, cores = counts.count(), counts.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, min(max(math.ceil(n / CHUNK_ROWS), cores), math.ceil(n / LEAST_ROWS)))
    placed = counts.withColumn("chunk", F.pmod(F.xxhash64("file_id"), F.lit(chunks)).cast("int"))
    pairs = placed.select(F.col("chunk").alias("its"), F.col("word").alias("name")).distinct()
    single = F.forall("vec", lambda v: v.isNull() | (v.cast("float").cast("double") == v))
    packed = vectors.select(
        "word", "weight", F.when(single, F.col("vec").cast("array<float>")).alias("short"), F.when(~single, F.col("vec")).alias("long")
    )
    used = pairs.join(shuffled(packed), F.col("name") == F.col("word")).select("its", "name", "weight", "short", "long")
    kind = counts.schema["file_id"].dataType.simpleString()

    def add(rows: pa.Table, words: pa.Table) -> pa.Table:
        # a word may have several vectors: places of the rows of ``words`` by word
        names = words.column("name").combine_chunks().dictionary_encode()
        code = names.indices.to_numpy()
        by_word = np.argsort(code, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(names.dictionary)))))
        vec, held = np.zeros((len(words), dim)), np.zeros((len(words), dim), bool)
        for c in ("short", "long"):
            lists = words.column(c).combine_chunks()
            own, flat = lists.is_valid().to_numpy(zero_copy_only=False), lists.flatten()
            held[own] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim)
            vec[own] = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
        weight = words.column("weight").combine_chunks()
        held &= weight.is_valid().to_numpy(zero_copy_only=False)[:, None]
        vec *= weight.fill_null(0.0).to_numpy(zero_copy_only=False)[:, None]
        at = pc.fill_null(pc.index_in(rows.column("word").combine_chunks(), value_set=names.dictionary), -1).to_numpy()
        rows, at = rows.filter(pa.array(at >= 0)), at[at >= 0]
        files = rows.column("file_id").combine_chunks().dictionary_encode()
        file, tf = files.indices.to_numpy(), rows.column("tf").to_numpy()
        times = first[at + 1] - first[at]
        row = np.repeat(np.arange(len(at)), times)
        place = by_word[np.repeat(first[at], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
        order = np.argsort(file[row], kind="stable")
        row, place = row[order], place[order]
        m = len(files.dictionary)
        known, sums, some = np.zeros(m, np.int64), np.zeros((m, dim)), np.zeros((m, dim), bool)
        for lo in range(0, len(row), SLICE_ROWS):
            r, p = row[lo : lo + SLICE_ROWS], place[lo : lo + SLICE_ROWS]
            own, starts = np.unique(file[r], return_index=True)
            known[own] += np.add.reduceat(tf[r], starts)
            sums[own] += np.add.reduceat(vec[p] * tf[r][:, None], starts, axis=0)
            some[own] |= np.logical_or.reduceat(held[p], starts, axis=0)
        flat = pa.array(sums.ravel(), mask=None if some.all() else ~some.ravel())
        return pa.table({"file_id": files.dictionary, "known": known, "sums": pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * dim, pa.int32()), flat)})

    return placed.groupBy("chunk").cogroup(used.groupBy("its")).applyInArrow(add, f"file_id {kind}, known bigint, sums array<double>")


def vectorizer_terms(text: Column) -> Column:
    """Terms of a text in the usual count-vector form: lower case, two word characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), 0)


def tfidf_l2(tf: DataFrame, n_files: Column) -> DataFrame:
    """Smoothed tf-idf, ``ln((1+N)/(1+df)) + 1``, with unit length per file; long form.

    The window of the norm holds the distinct words of one file, which is never more than the
    single row its text came in. The document counts are stored before they are joined back, so that Spark can
    split a word of most files; they are not broadcast, as there may be more words than files.
    """
    df = store(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    weight = F.col("tf") * (F.ln((1 + n_files) / (1 + F.col("df"))) + 1)
    weighted = tf.join(shuffled(df), "word").select("file_id", "word", weight.alias("weight"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("file_id")))
    return weighted.select("file_id", "word", (F.col("weight") / norm).alias("weight"))


def lsa(weights: DataFrame, components: int = 100, decimals: int = 2) -> DataFrame:
    """Truncated SVD of a long (file, word, weight) matrix: ``file_id, vec`` with U*S rounded.

    The matrix is not centred. Signs of the components are arbitrary; those beyond the rank are zero. Words stay in the tasks, the driver
    holds the vectors of a step and keeps the others in a file; the result is written some files at a time.
    """
    spark = weights.sparkSession
    weights, count = store_counted(weights)
    files = settle(running_totals(weights.select("file_id").distinct(), [F.col("file_id")], rank="row"))
    ids = files.select("row", "file_id").orderBy("row").toArrow().column("file_id")
    n, k = len(ids), min(components, weights.select("word").distinct().count(), len(ids))
    placed = weights.join(small_side(files, n), "file_id").select((F.col("row") - 1).alias("row"), F.col("word").alias("col"), F.col("weight").alias("value"))
    blocks = store(krylov.column_blocks(placed, count))
    blocks = blocks.repartition(max(1, min(blocks.count(), 2 * spark.sparkContext.defaultParallelism))).persist(StorageLevel.MEMORY_AND_DISK)
    path, at = new_path(spark), 0
    try:
        values, slices = krylov.leading(blocks, n, k) if n else (np.zeros(0), iter([np.zeros((0, 0))]))
        for part in slices:
            found = np.zeros((len(part), k))
            found[:, : len(values)] = np.round(part * np.sqrt(values), decimals) + 0.0
            offsets = pa.array(np.arange(len(part) + 1) * k, pa.int32())
            table = pa.table({"file_id": ids.slice(at, len(part)), "vec": pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))})
            result, at = store_at(spark.createDataFrame(table), path, "append"), at + len(part)
    finally:
        blocks.unpersist()
    return result


def doc_embed(
    texts: DataFrame, id_col: str, words: Column, size: int = 100, min_count: int = 2, seed: int = 100,
    partitions: int = 4, iterations: int = 3,
) -> DataFrame:
    """Document vectors as the average of word vectors trained on the same documents.

    ``partitions`` parts of the corpus are trained apart and averaged after each of ``iterations`` passes; neither depends
    on the machine.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    corpus = texts.select(F.col(id_col).alias("file_id"), words.alias("words"))
    model = Word2Vec(
        vectorSize=size, minCount=min_count, seed=seed, numPartitions=partitions, maxIter=iterations, inputCol="words", outputCol="v"
    ).fit(corpus)
    return model.transform(corpus).select("file_id", vector_to_array("v").alias("vec"))
