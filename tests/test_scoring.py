"""Quality, scoring and bug concentration: published values and brute force."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import cochange, hotspots, ordering, quality, scoring
from riskloom.plans import pipelines

# Scaled criteria and score of 23 clusters, in rank order.
RANKED = [
    (1, 0.996, 0.7249140296223424, 0.0702808603731558, 0.8171659212810032),
    (11, 0.003067096081588835, 0.263578947368421, 0.996, 0.19103096366415237),
    (36, 0.026276435856146002, 0.996, 0.17306335442543552, 0.17270304424189528),
    (7, 0.018273215244229736, 0.8303333333333333, 0.1639300222747787, 0.14443679689415398),
    (3, 0.014004830917874396, 0.5978187134502924, 0.1118329492487566, 0.10363373691043007),
    (22, 0.005201288244766506, 0.3217076023391813, 0.36487565527364224, 0.10158965523504067),
    (16, 0.022808373590982284, 0.3375608718766613, 0.18306574788646504, 0.08788910689710644),
    (35, 0.002, 0.031064327485380114, 0.44084432639811116, 0.07410790459921061),
    (24, 0.0028003220611916265, 0.496093567251462, 0.02737255477069228, 0.06947779864583777),
    (38, 0.022808373590982284, 0.2592731210742906, 0.08761508825414657, 0.06303657175377515),
    (9, 0.002, 0.14732163742690058, 0.2631945108455068, 0.061228264041490045),
    (14, 0.02414224369296833, 0.24420272904483428, 0.05917480079681275, 0.057639425006684765),
    (17, 0.004400966183574879, 0.341083820662768, 0.05181794459588546, 0.054686667952190945),
    (20, 0.002, 0.14732163742690058, 0.19657583001328024, 0.050844054543405),
    (23, 0.002, 0.14732163742690058, 0.17050765055719153, 0.04678066821806737),
    (6, 0.005468062265163714, 0.1639298245614035, 0.05393048670458117, 0.03321073760800331),
    (4, 0.0038674181427804616, 0.1763859649122807, 0.05073493413732458, 0.0331523697176839),
    (32, 0.0022667740203972087, 0.08919298245614035, 0.12428747421660873, 0.03236149274289662),
    (18, 0.0028003220611916265, 0.06012865497076023, 0.13746347941567066, 0.031094816021787743),
    (5, 0.007068706387546967, 0.05044054580896687, 0.042840412708141797, 0.01817035612725081),
    (12, 0.004400966183574879, 0.05689928525016245, 0.03059369302451212, 0.015172234425174427),
    (8, 0.0038674181427804616, 0.002, 0.07701909030544489, 0.015032044330594688),
    (26, 0.002, 0.031064327485380114, 0.002, 0.0057028961926265595),
]
WEIGHTS = {"bug_weight": 0.7167211897936407, "bug_density_file": 0.12740347061149732, "bug_density_loc": 0.15587533959486202}


def test_published_weights_and_scores(spark):
    rows = [(r[0], *r[1:4], 1) for r in RANKED]
    df = spark.createDataFrame(rows, "label INT, bug_weight DOUBLE, bug_density_file DOUBLE, bug_density_loc DOUBLE, bug_files INT")
    got = {r.criterion: r.weight for r in scoring.entropy_weights(df, hotspots.BUG_CRITERIA).collect()}
    assert got == pytest.approx(WEIGHTS, abs=1e-12)
    # each column already spans the full range, so ranking (which scales) leaves it as it is
    ranked = hotspots.rank_clusters(df).orderBy(F.col("score").desc()).collect()
    assert [r.label for r in ranked] == [r[0] for r in RANKED]
    assert [r.score for r in ranked] == pytest.approx([r[4] for r in RANKED], abs=1e-12)


def test_published_change_rates(spark):
    base = [(3, 0, 38517, 44, 736, 4, 114100, 26), (3, 1, 0, 36, 2, 738, 9, 114117), (3, 2, 0, 8, 2, 738, 17, 114109)]
    df = spark.createDataFrame(base, "k INT, label INT, in_change BIGINT, out_change BIGINT, in_file BIGINT, out_file BIGINT, in_loc BIGINT, out_loc BIGINT")
    got = [tuple(r[c] for c in quality.CRITERIA[:4]) for r in quality.with_rates(df).orderBy("label").collect()]
    want = [
        (0.07110445711247637, 0.014945652173913044, 2.958565337384907e-06, 1.4831793972898267e-05),
        (0, 0.024390243902439025, 0, 3.50517451387611e-05),
        (0, 0.005420054200542005, 0, 4.124023830671706e-06),
    ]
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-14)


def test_zero_lines_give_the_numerator(spark):
    df = spark.createDataFrame([(1, 0, 3, 5, 2, 0, 0, 7)], "k INT, label INT, in_change BIGINT, out_change BIGINT, in_file BIGINT, out_file BIGINT, in_loc BIGINT, out_loc BIGINT")
    safe, stored = quality.with_rates(df).first(), quality.with_rates(df, zero_safe=False).first()
    assert (safe.in_change_loc_r, safe.out_change_loc_r, safe.out_change_file_r) == (3, 5, None)
    assert (stored.in_change_loc_r, stored.out_change_loc_r) == (None, None)


def test_constant_criterion_and_single_row(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 3.0, 5.0), (3, 7.0, 5.0)], "k INT, x DOUBLE, y DOUBLE")
    scaled = scoring.minmax_scale(df, {"x": "pos", "y": "neg"})
    assert [r.y for r in scaled.collect()] == [None] * 3
    assert {r.criterion: r.weight for r in scoring.entropy_weights(scaled, ["x", "y"]).collect()} == {"x": 1.0, "y": 0.0}
    one = {r.criterion: r.weight for r in scoring.entropy_weights(df.filter("k = 1"), ["x", "y"]).collect()}
    assert one == {"x": 0.5, "y": 0.5}


def test_zero_value_adds_nothing_to_the_entropy(spark):
    xs = [0.0, 1.0, 3.0]
    df = spark.createDataFrame([(x, y) for x, y in zip(xs, [1.0, 1.0, 2.0])], "x DOUBLE, y DOUBLE")

    def d(values):
        s = sum(values)
        return 1 + sum(v / s * math.log(v / s) for v in values if v) / math.log(len(values))

    dx, dy = d(xs), d([1.0, 1.0, 2.0])
    got = {r.criterion: r.weight for r in scoring.entropy_weights(df, ["x", "y"]).collect()}
    assert got == pytest.approx({"x": dx / (dx + dy), "y": dy / (dx + dy)})


@pytest.mark.parametrize("chunk", [2, 512])
def test_cochange_with_a_huge_commit(spark, chunk):
    rng = random.Random(9)
    commits = {c: set(rng.choices(range(25), k=rng.randint(1, 6))) for c in range(40)}
    commits[99] = set(range(25))
    want = collections.Counter(p for fs in commits.values() for p in itertools.combinations(sorted(fs), 2))
    touched = spark.createDataFrame([(c, f) for c, fs in commits.items() for f in fs], "commit BIGINT, file_id BIGINT")
    edges = cochange.cochange(touched, chunk=chunk).cache()
    assert {(r.a, r.b): r.w for r in edges.collect()} == dict(want)
    degree = {r.file_id: r.degree for r in cochange.cochange_degree(touched).collect()}
    assert degree == {r.file_id: r.degree for r in cochange.degree_of_edges(edges).collect()}
    labels = spark.createDataFrame([(k, f, f % k) for k in (2, 5) for f in range(25)], "k BIGINT, file_id BIGINT, label BIGINT")
    loc = spark.createDataFrame([(f, f) for f in range(25)], "file_id BIGINT, loc BIGINT")
    by_rows = quality.cluster_data(labels, loc, touched=touched).orderBy("k", "label").collect()
    by_edges = quality.cluster_data(labels, loc, edges=edges).orderBy("k", "label").collect()
    assert by_rows == by_edges
    for k in (2, 5):
        mine = [r for r in by_rows if r.k == k]
        assert 2 * sum(r.in_change for r in mine) + sum(r.out_change for r in mine) == 2 * sum(want.values())


def test_running_totals_and_rank_within(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 3), rng.randint(-5, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "id BIGINT, g INT, v BIGINT").repartition(7)
    got = ordering.running_totals(df, [F.col("v").desc(), F.col("id")], {"run": "v"}).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [r.id for r in got] == [r[0] for r in want] and [r.rank for r in got] == list(range(1, 201))
    assert [r.run for r in got] == list(itertools.accumulate(r[2] for r in want))
    ranks = {r.id: r.rank for r in ordering.rank_within(df, ["g"], [F.col("id")]).collect()}
    seen = collections.Counter()
    for i, g, _ in rows:
        seen[g] += 1
        assert ranks[i] == seen[g]


def test_bug_concentration_by_hand(spark):
    # files 0-5; clusters 0: {0,1}, 1: {2,3}, 2: {4,5}
    labels = spark.createDataFrame([(f, f // 2) for f in range(6)], "file_id BIGINT, label INT")
    loc = spark.createDataFrame([(f, 10 * (f + 1)) for f in range(6)], "file_id BIGINT, loc BIGINT")
    rows = [  # commit, file, insertions, deletions
        ("c1", 0, "1", "2"), ("c1", 0, "1", "0"), ("c1", 1, "-", "-"),
        ("c2", 0, "5", "5"), ("c2", 2, "1", "1"),
        ("c3", 2, "2", "0"), ("c4", 1, "1", "1"), ("c5", 4, "3", "3"),
    ]
    changes = hotspots.with_churn(spark.createDataFrame(rows, "commit STRING, file_id BIGINT, insertions STRING, deletions STRING"))
    space = {r.file_id: r.bugs for r in hotspots.bug_space(changes, labels).collect()}
    assert space == {0: 3, 1: 2, 2: 2}
    local = {r.label: (r.bf, r.bf_in, r.bf_out) for r in hotspots.fix_locality(changes, labels).collect()}
    assert local == {0: (2, 4, 1), 1: (1, 4, 1), 2: (1, 4, 1)}
    assert {r.label: r.churn for r in hotspots.churn_by_cluster(changes, labels).collect()} == {0: 16, 1: 4, 2: 6}
    ranked = spark.createDataFrame([(0, 0.9, 0.9, 0.9, 0.9, 2), (1, 0.1, 0.1, 0.1, 0.1, 1)],
                                   "label INT, bug_weight DOUBLE, bug_density_file DOUBLE, bug_density_loc DOUBLE, score DOUBLE, bug_files INT")
    top = hotspots.top_clusters(ranked)
    assert [(r.label, r["rank"], r.running, r.threshold) for r in top.collect()] == [(0, 1, 2, 2)]
    report = hotspots.risk_report(changes, labels, loc, ranked, top, "p").first()
    assert (report.bf_in, report.bf_out, report.cluster_sum, report.file_sum) == (4, 1, 3, 6)
    assert (report.fr, report.loc, report.bc, report.bfr) == pytest.approx((2 / 6, 30 / 210, 16 / 26, 2 / 5))
    assert (report.density_bf_file, report.density_bf_loc, report.bfin_bfr) == pytest.approx((1.0, 2 / 30, 0.5))
    assert report.top_buggy_cluster == [0] and report.project == "p"
    # densities are those counted, which may exceed one
    dense = ranked.drop("bug_density_file").withColumn("bug_density_file", F.lit(6.5))
    raw = hotspots.risk_report(changes, labels, loc, dense, top, "p")
    assert raw.first().bug_density_file_average == 6.5
    stored = hotspots.stored_top(raw, "p").collect()
    assert [(r.label, r["rank"]) for r in stored] == [(0, 1)]
    after = hotspots.next_release_report(changes, labels, top, "p").first()
    assert (after.bc_top, after.bc_all) == pytest.approx((6 / 26, 14 / 26))
    assert (after.bfr_top, after.bfr_all, after.bftop_in_bfin) == pytest.approx((2 / 5, 4 / 5, 2 / 4))


def test_no_bugs_at_all(spark):
    labels = spark.createDataFrame([(f, f // 2) for f in range(6)], "file_id BIGINT, label INT")
    loc = spark.createDataFrame([(f, 10) for f in range(6)], "file_id BIGINT, loc BIGINT")
    none = spark.createDataFrame([], "commit STRING, file_id BIGINT, churn BIGINT")
    risk = pipelines.rank_risk(none, labels, loc)
    assert risk.top.count() == 0
    report = hotspots.risk_report(none, labels, loc, risk.decision, risk.top, "p").first()
    assert (report.bf_in, report.bfr, report.top_buggy_cluster) == (0, None, [])


def test_one_hot_file_and_one_hot_commit(spark):
    """A third of all rows on one file and a third in one commit give the same answers as counting by hand."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 80), rng.randint(0, 30), rng.randint(0, 5)) for _ in range(300)]
    rows += [(1000 + i, 7, 1) for i in range(300)] + [(999, i % 31, 2) for i in range(300)]
    changes = spark.createDataFrame(rows, "commit BIGINT, file_id BIGINT, churn BIGINT").repartition(5)
    labels = spark.createDataFrame([(f, f % 4) for f in range(31)], "file_id BIGINT, label INT")
    bugs = collections.Counter(f for _, f, _ in rows)
    assert {r.file_id: r.bugs for r in hotspots.bug_space(changes, labels).collect()} == {f: n for f, n in bugs.items() if n >= 2}
    clusters = collections.defaultdict(set)
    for c, f, _ in rows:
        clusters[c].add(f % 4)
    inside = collections.Counter(next(iter(s)) for s in clusters.values() if len(s) == 1)
    out = sum(len(s) > 1 for s in clusters.values())
    got = hotspots.fix_locality(changes, labels).collect()
    assert {r.label: r.bf for r in got} == dict(inside)
    assert {(r.bf_in, r.bf_out) for r in got} == {(sum(inside.values()), out)}
    touched = cochange.touches(changes)
    files = collections.defaultdict(set)
    for c, f, _ in rows:
        files[c].add(f)
    want = collections.Counter(p for s in files.values() for p in itertools.combinations(sorted(s), 2))
    assert {(r.a, r.b): r.w for r in cochange.cochange(touched, chunk=8).collect()} == dict(want)
