import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import packing, quality_classifier, quality_rules, simhash
from test_shingle_sets import slow_groups
from test_suffix_dedup import brute as without_strings

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    stems = ["water", "river", "stone", "garden", "window", "letter", "music", "summer", "winter", "market"]
    return " ".join(rng.choice(stems) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 3
        text = " ".join(f"{w}###" for w in prose(rng, 80).split()) if bad else prose(rng, rng.randint(60, 200))
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    shared = prose(rng, 90)
    rows += [(200 + i, f"{prose(rng, 60)} {shared} {prose(rng, 60)}") for i in range(6)]
    words = rows[0][1].split()
    rows += [(250 + k, " ".join(["other" if 20 <= j < 20 + k else w for j, w in enumerate(words)])) for k in (1, 2, 12, 30)]  # similarities on both sides of 0.8
    rows += [(300 + i, rows[0][1]) for i in range(9)] + [(301, rows[0][1]), (400, "too short"), (401, None), (402, ""), (None, prose(rng, 70)), (None, rows[1][1])]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, full


def test_stages_equal_brute_force(spark, corpus):
    folder, full = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("row", F.lit("clash"))
    (_, good), (_, rules), (_, single), (_, strings), (_, pack) = corpus_pipeline.STAGES
    stage = lambda fn, rows: [tuple(r) for r in fn(spark, rows if hasattr(rows, "columns") else spark.createDataFrame(rows, SCHEMA), folder).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")

    kept = stage(good, docs)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    want = [r for r in full if model.score(quality_classifier.features((r[1] or "").encode())[None])[0] >= quality_classifier.THRESHOLD]
    assert sorted(kept, key=key) == sorted(want, key=key)
    ids = {r[0] for r in kept}
    assert not ids & {i for i in range(120) if i % 4 == 3} and {i for i in range(120) if i % 4 != 3} <= ids

    ruled = stage(rules, kept)
    assert {r[0] for r in ruled} == {r[0] for r in kept if len((r[1] or "").split()) >= 20}

    alone = stage(single, ruled)
    parts = slow_groups([r[:2] for r in ruled])
    best = {}
    for n, r in enumerate(ruled):
        best[parts[n]] = min(best.get(parts[n], (True, 1 << 60)), (r[0] is None, r[0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in alone) == sorted(best.values())

    left = stage(strings, alone)
    want = without_strings([(r[0], r[1]) for r in alone], 400)
    assert sorted((r[0] is None, r[0] or 0, r[1]) for r in left) == sorted((a, b, text.decode("utf-8", "ignore")) for a, b, _, _, _, text in want)
    assert all(r[4] == len(r[1]) for r in left)

    rows = pack(spark, spark.createDataFrame(left, SCHEMA), folder).collect()
    t = packing.WordTokenizer(packing.tokenizer_path())
    want = sorted(zlib.crc32(t.ids(r[1]) + b"\1\0\0\0") for r in left)
    assert sorted(r.ids_crc32 for r in rows) == want
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.ids_crc32 for r in whole) == want


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_are_those_of_the_current_policy():
    assert quality_rules.CURRENT in quality_rules.POLICIES


def test_near_duplicates_by_fingerprint_are_one(spark, tmp_path):
    """Texts whose fingerprints are within two bits are one even if they share fewer shingles of five words; links of both kinds chain."""
    rng = random.Random(11)
    body = [prose(rng, 31)] * 40  # of an odd number of shingles, which outvote those of a few more words
    one, other = " ".join(body), " ".join([*body, prose(rng, 15)])
    rows = [(1, one), (2, other), (3, other + " end"), (4, prose(rng, 100)), (4, prose(rng, 100)), (None, one), (None, None), (9, "")]
    assert (simhash.fingerprint(one.encode()) ^ simhash.fingerprint(other.encode())).bit_count() <= 2
    assert len(set(slow_groups([(1, one), (2, other)]))) == 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, one), (4, rows[3][1]), (4, rows[4][1]), (9, "")])
