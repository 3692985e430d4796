"""One query per corpus operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import (
    alignment, embedding_dedup, language, nnls_packing, packing, pieces, quality_classifier, quality_rules, simhash, substring_dedup,
    suffix_dedup, url_filters, whitening,
)
from riskloom.llm.oracle import ORACLE  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    return url_filters.judge(pages, url_filters.alias_edges(pages))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return entries.select(
        "doc_id", *quality_rules.MEASUREMENTS, "failures",
        quality_rules.rejects(quality_rules.BASE).alias("base_failed"),
        (~quality_rules.rejects(quality_rules.POLICIES[quality_rules.CURRENT])).alias("kept"),
    )


@query
def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "quality")
    out = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.train(docs.filter(~out), labels.filter(~out))
    scored = quality_classifier.score(docs, model)
    keep = F.col("score") >= quality_classifier.THRESHOLD
    return scored.select("doc_id", out.alias("held_out"), "score", keep.cast("int").alias("predicted"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs.filter(~out))
    return language.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()))


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return found.select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded, and decoded again."""
    path = packing.tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    back = pieces.decode(pieces.encode(docs, path), path)
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.deduplicate(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packing.tokenizer_path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return nnls_packing.pack(nnls_packing.pieces(docs, path), path)


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.align(docs, packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("piece_bpe_32k.model"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is NULL where it does not fit 64 bits; deviation_exact has it up to 38 digits."""
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    model = whitening.fit(vectors)
    shares = F.array(*[F.lit(float(v) / model.trace) for v in model.values]).cast("array<double>")
    return whitening.whiten(vectors, model).select(
        "vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), F.col("deviation").try_cast("bigint").alias("deviation"), "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(whitening.identity_error(vectors, model)).alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


QUERIES["pipeline"] = corpus_pipeline.run
