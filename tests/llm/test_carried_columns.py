"""Columns handed on: clear errors for names that an operator uses itself, at the call and before any job."""

import pytest

from riskloom.llm import quality_classifier, quality_rules, shingle_sets, simhash, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    columns = "doc_id bigint, text string, n_words bigint, fp bigint, row bigint, n_bytes bigint, score double, sid bigint, note string"
    return spark.createDataFrame([(i, f"text number {i} with some words", 1, 2, 3 + i, 4, 0.5, 6, f"note {i}") for i in range(4)], columns)


def test_clashing_names_raise(spark, docs):
    model = quality_classifier.fit_nnpu(quality_classifier.features(b"a b")[None][:0], quality_classifier.features(b"a b")[None], 0.5)
    ranges = spark.createDataFrame([], "row bigint, low bigint, end bigint")
    for call in (
        lambda: quality_rules.ledger(docs, ["n_words"]), lambda: simhash.near_duplicates(docs, carry=["fp"]), lambda: suffix_dedup.remove(docs, ranges, ["n_bytes"]),
        lambda: quality_classifier.score(docs, model, ["score"]), lambda: shingle_sets.near_duplicates(docs, "doc_id", ["sid"]), lambda: quality_rules.ledger(docs, ["note", "note"]),
    ):
        with pytest.raises(ValueError):
            call()


def test_other_names_are_handed_on(docs):
    notes = {i: f"note {i}" for i in range(4)}
    assert {r.doc_id: r.note for r in quality_rules.ledger(docs, ["note", "row"]).collect()} == notes
    assert {r.doc_id: r.note for r in simhash.near_duplicates(docs, carry=["note"]).collect()} == notes
    # a table that has a column "row" of its own
    got = shingle_sets.near_duplicates(docs, "doc_id", ["note"]).collect()
    assert {r.doc_id: r.note for r in got} == notes and len({r.group for r in got}) == 4
