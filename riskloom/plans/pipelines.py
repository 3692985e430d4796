"""Whole analyses put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import cochange, hierarchy, hotspots, kmeans, linkage, quality, scoring, splitting, text
from riskloom.runtime import attach, settle, store


class RiskRanking(NamedTuple):
    space: DataFrame
    decision: DataFrame
    ranked: DataFrame
    top: DataFrame


def rank_risk(
    fixes: DataFrame, labels: DataFrame, loc: DataFrame, min_bugs: int = 2, share: float = 0.8, by: Sequence[str] = ()
) -> RiskRanking:
    """Bug space, bug criteria, ranked clusters and the top clusters.

    The criteria, one row per cluster, are computed once; everything after works on that table. ``by`` names the columns of
    all three tables that tell projects apart; each project is then ranked by itself, all in the same jobs.
    """
    space = hotspots.bug_space(fixes, labels, min_bugs, by)
    sizes = labels.join(loc, [*by, "file_id"]).groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("in_file"), F.sum("loc").alias("in_loc")
    )
    decision = settle(hotspots.bug_decision(settle(space), sizes, by))
    ranked = settle(hotspots.rank_clusters(decision, by))
    return RiskRanking(space, decision, ranked, hotspots.top_clusters(ranked, share, by))


def score_cuts(per_k: DataFrame, compat_sign_flip: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Scaled criteria and score per k, for each project of ``by`` by itself.

    The out-change criteria are scaled so that less is better and then counted with a minus sign, which
    rewards more out-change; ``compat_sign_flip=False`` counts them as scaled.
    """
    per_k = settle(per_k)
    scaled = scoring.minmax_scale(per_k.select(*by, "k", *quality.CRITERIA), quality.DIRECTIONS, by=by)
    weights = scoring.entropy_weights_row(scaled, quality.CRITERIA, by)
    negated = ["out_change_file_r", "out_change_loc_r"] if compat_sign_flip else []
    return scoring.weighted_sum(scaled, quality.CRITERIA, weights, negated, by=by)


def labelled_criteria(labels_k: DataFrame, loc: DataFrame, touched: DataFrame) -> DataFrame:
    """Criteria per k of any label table."""
    clusters = quality.cluster_data(labels_k, loc, touched=touched)
    return quality.k_criteria(clusters, quality.ned(labels_k))


class Dendrogram(NamedTuple):
    merges: DataFrame
    leaves: DataFrame


def dendrogram(vectors: DataFrame, loc: DataFrame, touched: DataFrame, by: Sequence[str] = ()) -> Dendrogram:
    """Average-linkage dendrogram of the files that have a vector, with their co-change.

    ``vectors``: ``file_id, vec``; ``loc``: ``file_id, loc``; ``touched``: distinct ``commit, file_id``. A file without lines of code
    counts with none. ``by`` names the columns of ``vectors`` that tell projects apart (file ids do so as well); all are
    clustered in the same rounds, and a commit counts in each project for itself.
    """
    files = settle(vectors.select(*by, "file_id").join(loc.select("file_id", "loc"), "file_id", "left").withColumn("loc", F.coalesce("loc", F.lit(0))))
    if by:
        touched = touched.join(files.select(*by, "file_id"), "file_id").select(F.struct(*by, "commit").alias("commit"), "file_id")
    else:
        touched = touched.join(files.select("file_id"), "file_id", "left_semi")
    within = settle(touched)
    leaves = settle(hierarchy.leaf_nodes(files, cochange.cochange_degree(within), by))
    pairs = hierarchy.linkage_pairs(linkage.VectorPairs(vectors), cochange.cochange(within))
    return Dendrogram(hierarchy.agglomerate(pairs, leaves, by), leaves)


def select_clusters(tree: Dendrogram, compat_sign_flip: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Best cut of a dendrogram over all k: ``files, iteration, f_optimal, score``; with ``by``, of each project that has a complete cut."""
    per_k = quality.keep_complete(hierarchy.sweep_criteria(tree.merges, tree.leaves, by=by), by)
    best = scoring.best_k(score_cuts(per_k, compat_sign_flip, by), by=by)
    sizes = tree.leaves.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("_t.n")
    return attach(best, sizes, "_t", by).select(*by, n.alias("files"), n.alias("iteration"), F.col("k").alias("f_optimal"), "score")


def chosen_labels(tree: Dendrogram, best: DataFrame, by: Sequence[str]) -> DataFrame:
    """Labels ``(by, file_id, label)`` of the best cut of each project (``best`` from ``select_clusters``)."""
    roots = hierarchy.cut_by(tree.merges, tree.leaves, best.select(*by, F.col("f_optimal").alias("k")), by)
    return roots.select(*by, "file_id", "label")


def result_row(best: DataFrame, project: str, version: str, run_time: float) -> DataFrame:
    """The row that a run appends to its result table."""
    return best.select(
        F.lit(project).alias("project"), F.lit(version).alias("version"), F.col("files").alias("file_sum"),
        "iteration", "f_optimal", F.lit(float(run_time)).alias("run_time"),
    )


VECTORIZERS = ("c2v_tfidf", "c2v", "tfidf_lsa", "doc_embed")


def file_vectors(
    texts: DataFrame, id_col: str, text_col: str, vectorizer: str = "c2v_tfidf",
    token_vectors: DataFrame | None = None, dim: int | None = None, split_identifiers: bool = True, split_glued: int | None = None,
) -> DataFrame:
    """``file_id, vec`` by name of the vectoriser; identifiers are split into their words first.

    With ``split_glued`` words glued without a change of case are split as well, into words that the texts hold that often (not for doc_embed).
    """
    if vectorizer not in VECTORIZERS:
        raise ValueError(f"unknown vectorizer {vectorizer!r}; choose one of {VECTORIZERS}")
    if vectorizer == "doc_embed":
        return text.doc_embed(texts, id_col, text.clean_words(F.col(text_col), split_identifiers=split_identifiers))
    files = texts.select(F.col(id_col).alias("file_id"))
    n = files.agg(F.count(F.lit(1)).alias("n")).scalar()
    tf = store(text.text_words(texts, id_col, text_col, split_identifiers=split_identifiers))  # read by the weights and by the sums
    if split_glued is not None:
        tf = store(splitting.split_words(tf, store(splitting.splits(tf, splitting.unigrams(tf, split_glued)))))
    if vectorizer == "tfidf_lsa":
        return text.lsa(text.tfidf_l2(tf, n))
    if token_vectors is None or dim is None:
        raise ValueError(f"{vectorizer} needs token_vectors and dim")
    weights = text.idf(tf, n) if vectorizer == "c2v_tfidf" else None
    return text.doc_vectors(tf, token_vectors, dim, files, weights, n).select("file_id", "vec")


def kmeans_criteria(rows: DataFrame, ks, loc: DataFrame, touched: DataFrame, restarts: int = 10) -> DataFrame:
    """Criteria per k of k-means labels."""
    labels = kmeans.kmeans_labels(rows, ks, restarts).select("k", "file_id", "label")
    return labelled_criteria(labels, loc, touched)


def select_kmeans(rows: DataFrame, loc: DataFrame, touched: DataFrame, restarts: int = 10, compat_sign_flip: bool = True) -> DataFrame:
    """Best k of k-means over all k from 2 to the number of distinct rows: ``files, iteration, f_optimal, score``.

    ``rows`` are rows of the distance matrix of the files to group.
    """
    limit = kmeans.sweep_limit(rows).first()
    labels = store(kmeans.kmeans_labels(rows, range(2, limit.iteration + 1), restarts).select("k", "file_id", "label"))
    best = scoring.best_k(score_cuts(labelled_criteria(labels, loc, touched), compat_sign_flip))
    return best.select(
        F.lit(limit.files).alias("files"), F.lit(limit.iteration).alias("iteration"), F.col("k").alias("f_optimal"), "score"
    )
