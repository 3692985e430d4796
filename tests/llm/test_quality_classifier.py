import os
import random

import numpy as np
import pytest

from riskloom.llm import quality_classifier as qc
from riskloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    ones = np.asarray(labels) == 1
    n, m = ones.sum(), (~ones).sum()
    return (rank[ones].sum() - n * (n - 1) / 2) / (n * m)


def test_risk_finds_the_boundary_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 6)).astype(np.float32)
    x[:, 0] = 1
    y = (x[:, 1] + x[:, 2] > -0.6).astype(int)
    model = qc.fit_nnpu(x[:2000][y[:2000] == 1], x[2000:], float(y.mean()))
    assert auc(model.score(x), y) > 0.95
    assert qc.fit_nnpu(x[:0], x, 0.4).score(x) == pytest.approx(0.4, abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    rows = QUERIES["op7_quality_classifier"](spark, FOLDER).toPandas()
    assert rows["doc_id"].is_unique and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    known = rows.merge(spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas(), on="doc_id")
    out = known[known["held_out"]]
    assert auc(out["score"], out["quality"]) > 0.9


def test_nulls_repeats_and_clashing_columns(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["good", "text", "here"]) for _ in range(50)) if i % 2 else "### $$$ " * 30) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (None, 1), (2, None), (3, 7)], "doc_id bigint, quality int")
    docs = docs_of([*rows, (200, None), (201, ""), (None, "good text"), (1, rows[1][1]), (202, "good " * 100_000)]).withColumnRenamed("words", "score")
    got = qc.score(docs, qc.train(docs, labels)).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert qc.score(docs_of([]), qc.train(docs_of([]), labels)).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(int(100 * share))
    rows = lambda n, at: np.hstack([np.ones((n, 1)), rng.standard_normal((n, 5)) + at]).astype(np.float32)
    n = 6000
    mixed = np.concatenate([rows(int(share * n), 1.2), rows(n - int(share * n), -1.2)])
    found = qc.mixture_prior(rows(3000, 1.2), mixed[rng.permutation(n)])
    assert share - 0.03 < found < share + 0.06
    assert qc.mixture_prior(mixed[:0], mixed) == 0.5


def test_labels_of_ones_only(spark, docs_of):
    """Trusted positives and no negatives: rejected texts are still told apart."""
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["river", "stone", "garden", "window", "letter"]) + rng.choice("aeiou") for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["###", "$$$", "%%", "||", "<>"]) * 3 for _ in range(60))
    rows = [(i, bad() if i % 5 < 2 else good()) for i in range(600)]
    labels = spark.createDataFrame([(i, 1) for i in range(600) if i % 5 >= 2 and i % 3 == 0], "doc_id bigint, quality int")
    model = qc.train(docs_of(rows), labels)
    assert 0.5 < model.prior < 0.75
    got = {r.doc_id: r.score for r in qc.score(docs_of(rows), model).collect()}
    wrong = sum((got[i] >= qc.THRESHOLD) != (i % 5 >= 2) for i, _ in rows)
    assert wrong <= 6
    share = qc.labelled_prior(spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id bigint, quality int"))
    assert share == 0.5 and qc.train(docs_of(rows), labels, prior=0.6).prior == 0.6


def test_query_scores_equal_the_model_text_by_text(spark):
    """The query against its own model applied to one text at a time, over the whole smallest table."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    import binascii

    out = lambda i: binascii.crc32(str(i).encode()) % 5 == 0
    held = qc.held_out(docs.doc_id)
    model = qc.train(docs.filter(~held).select("doc_id", "text"), labels.filter(~qc.held_out(labels.doc_id)).select("doc_id", "quality"))
    want = {r.doc_id: float(model.score(qc.features((r.text or "").encode())[None])[0]) for r in docs.collect()}
    rows = QUERIES["op7_quality_classifier"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(want) and all(r.held_out == out(r.doc_id) and r.predicted == (r.score >= 0.3) for r in rows)
    assert max(abs(r.score - want[r.doc_id]) for r in rows) < 1e-4
