"""Words, weights and vectors against plain Python."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.stopwords import ENGLISH
from riskloom.operators import krylov, text
from riskloom.plans import pipelines
from riskloom.plans.views import Tables

TEXTS = {
    0: "The quick brown fox. the getUserName x 12 and Über-cool",
    1: "quick quick fox's den AND THE end",
    2: "",
    3: "unseenword another_unseen",
    4: "brown den fox",
}
VECTORS = {"quick": [1.0, 2.0], "fox": [0.5, -1.0], "brown": [3.0, 0.0], "den": [-2.0, 4.0], "the": [1.0, 1.0]}


def words(t):
    kept = [w for w in re.sub("[^a-zA-Z]", " ", t).split() if w not in set(ENGLISH)]
    return [w.lower() for w in kept if len(w) > 1]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id BIGINT, text STRING")


def test_stop_words_go_before_lower_casing(spark, corpus):
    got = {r.doc_id: r.w for r in corpus.select("doc_id", text.clean_words(F.col("text")).alias("w")).collect()}
    assert got == {i: words(t) for i, t in TEXTS.items()}
    assert got[0].count("the") == 1 and "and" in got[1]
    split = corpus.select(text.clean_words(F.col("text"), split_identifiers=True).alias("w")).first().w
    assert {"get", "user", "name"} <= set(split)


def test_tokens_skip_two_rows(spark):
    rows = [(1, 0, "skipped words", "Comment"), (1, 1, "skippedToo", "Identifier"), (1, 2, "kept one", "Comment"), (1, 3, "if", "Keyword"), (1, 4, "kept", "Identifier")]
    tokens = spark.createDataFrame(rows, "file_id BIGINT, pos INT, text STRING, token_type STRING")
    assert {r.word: r.tf for r in text.documents(tokens).collect()} == {"kept": 2, "one": 1}


def test_idf_and_weighted_mean(spark, corpus):
    docs = {i: words(t) for i, t in TEXTS.items()}
    df = collections.Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(len(docs) / (1 + n)) for w, n in df.items()}
    n = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    tf = text.text_words(corpus, "doc_id", "text").cache()
    got = {r.word: (r.df, r.idf) for r in text.idf(tf, n).collect()}
    assert {w: v[0] for w, v in got.items()} == dict(df)
    assert {w: v[1] for w, v in got.items()} == pytest.approx(idf)
    vectors = spark.createDataFrame(list(VECTORS.items()), "token STRING, vec ARRAY<DOUBLE>")
    files = corpus.select(F.col("doc_id").alias("file_id"))
    for weights in (text.idf(tf, n), None):
        for r in text.doc_vectors(tf, vectors, 2, files, weights, n).collect():
            known = [w for w in docs[r.file_id] if w in VECTORS]
            want = np.zeros(2)
            for w in known:
                want += np.array(VECTORS[w]) * (idf[w] if weights is not None else 1)
            assert r.known == len(known)
            assert r.vec == pytest.approx(list(want / max(len(known), 1)))
    tf.unpersist()


def test_file_sums_are_not_shuffled_in_parts(spark):
    """Sums of a file are made in one place; missing entries, repeated words and vectors of either precision count as in plain sums."""
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "x", 1), (2, "b", 1), (3, "x", 4), (4, "c", 2)], "file_id bigint, word string, tf bigint")
    vectors = spark.createDataFrame([("a", [0.5, 0.1]), ("b", [2.0, None]), ("b", [1.0, 4.0]), ("c", [None, 1.5]), ("d", [1.0, 1.0])], "token string, vec array<double>")
    found = text.doc_vectors(tf, vectors, 2, spark.range(1, 6).withColumnRenamed("id", "file_id"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "partial_sum" not in plan
    got = {r.file_id: (r.known, r.vec) for r in found.collect()}
    assert got[1] == (8, [(2 * 0.5 + 3 * 2.0 + 3 * 1.0) / 8, (2 * 0.1 + 3 * 4.0) / 8])
    assert got[2] == (2, [1.5, 2.0]) and got[3] == got[5] == (0, [0.0, 0.0]) and got[4] == (2, [None, 1.5])


def test_smoothed_tfidf_has_unit_length(spark):
    paths = {1: "a/Foo.java", 2: "b/foo_bar.java", 3: "Foo/foo.py"}
    df = spark.createDataFrame(list(paths.items()), "file_id BIGINT, path STRING")
    tf = text.count_words(df.select("file_id", F.explode(text.vectorizer_terms(F.col("path"))).alias("word")))
    got = {(r.file_id, r.word): r.weight for r in text.tfidf_l2(tf, df.agg(F.count(F.lit(1)).alias("n")).scalar()).collect()}
    terms = {i: collections.Counter(re.findall(r"\b\w\w+\b", p.lower())) for i, p in paths.items()}
    n_with = collections.Counter(w for c in terms.values() for w in c)
    for i, c in terms.items():
        raw = {w: k * (math.log(4 / (1 + n_with[w])) + 1) for w, k in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            assert got[i, w] == pytest.approx(v / norm)


def test_lsa_keeps_products(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(0, 3, size=(9, 14)) * rng.random(size=(9, 14)) * 30
    cells = [(i, f"w{j:02d}", float(m[i, j])) for i in range(9) for j in range(14) if m[i, j]]
    weights = spark.createDataFrame(cells, "file_id BIGINT, word STRING, weight DOUBLE")
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = (u[:, :4] * s[:4]) @ (u[:, :4] * s[:4]).T
    rows = {r.file_id: r.vec for r in text.lsa(weights, components=4, decimals=8).collect()}
    got = np.array([rows[i] for i in range(9)])
    assert got @ got.T == pytest.approx(want, abs=1e-4)


def test_lsa_of_the_documents_equals_numpy(spark):
    """Inner products of all components against a dense solver, on the test documents."""
    folder = "/root/testdata/sf0.001"
    t = Tables(spark, folder)
    weights = text.tfidf_l2(t.tf(), t.n_documents()).cache()
    cells = weights.toPandas()
    files, words = cells.file_id.astype("category"), cells.word.astype("category")
    m = np.zeros((len(files.cat.categories), len(words.cat.categories)))
    m[files.cat.codes, words.cat.codes] = cells.weight
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    rows = {r.file_id: r.vec for r in text.lsa(weights, decimals=10).collect()}
    got = np.array([rows[i] for i in files.cat.categories])
    # a component is free in sign, and within equal strengths in direction
    apart = s[99] - s[100] > 1e-6
    assert np.sqrt((got * got).sum(0)) == pytest.approx(s[:100], abs=1e-7)
    if apart:
        assert np.abs(got @ got.T - (u[:, :100] * s[:100] ** 2) @ u[:, :100].T).max() < 1e-6
    weights.unpersist()


def test_lsa_holds_few_vectors_at_a_time(spark, monkeypatch):
    """With little memory for the basis, steps and the result, all components are the same."""
    rng = np.random.default_rng(9)
    m = rng.integers(0, 2, size=(60, 40)) * rng.random(size=(60, 40)) * 30
    cells = [(i, f"w{j:02d}", float(m[i, j])) for i in range(60) for j in range(40) if m[i, j]]
    weights = spark.createDataFrame(cells, "file_id BIGINT, word STRING, weight DOUBLE")
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    monkeypatch.setattr(krylov, "BASIS_BYTES", 8 * 60 * 4, raising=False)
    monkeypatch.setattr(krylov, "STEP_BYTES", 8 * 60 * 4, raising=False)
    monkeypatch.setattr(krylov, "SLICE_BYTES", 8 * 6 * 17, raising=False)
    shapes, product = [], krylov.multiply
    monkeypatch.setattr(krylov, "multiply", lambda blocks, vectors: shapes.append(vectors.shape) or product(blocks, vectors))
    rows = {r.file_id: r.vec for r in text.lsa(weights, components=6, decimals=8).collect()}
    got = np.array([rows[i] for i in range(60)])
    assert max(shapes) == (60, 4)
    assert np.abs(got @ got.T - (u[:, :6] * s[:6] ** 2) @ u[:, :6].T).max() < 1e-4


def test_lsa_of_low_rank_and_of_nothing(spark):
    cells = [(i, w, 1.0 + i % 2) for i in range(30) for w in ("a", "b", "c")]
    frame = spark.createDataFrame(cells, "file_id BIGINT, word STRING, weight DOUBLE")
    rows = {r.file_id: r.vec for r in text.lsa(frame, components=3, decimals=6).collect()}
    got = np.array([rows[i] for i in range(30)])
    m = np.array([[1.0 + i % 2] * 3 for i in range(30)])
    assert got.shape == (30, 3) and np.abs(got @ got.T - m @ m.T).max() < 1e-4
    assert text.lsa(frame.limit(0), components=3).count() == 0


def test_vectorizers_by_name(spark, corpus):
    vectors = spark.createDataFrame(list(VECTORS.items()), "token STRING, vec ARRAY<DOUBLE>")
    for name in ("c2v_tfidf", "c2v"):
        assert pipelines.file_vectors(corpus, "doc_id", "text", name, vectors, 2).count() == 5
    embedded = pipelines.file_vectors(corpus, "doc_id", "text", "doc_embed").collect()
    assert len(embedded) == 5 and all(len(r.vec) == 100 for r in embedded)
    with pytest.raises(ValueError):
        pipelines.file_vectors(corpus, "doc_id", "text", "other")
    with pytest.raises(ValueError):
        pipelines.file_vectors(corpus, "doc_id", "text", "c2v")
