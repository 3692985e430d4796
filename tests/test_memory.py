"""What a task holds and sorts stays small: plans of the steps that made tasks grow."""

import collections
import itertools
import random

from riskloom.operators import cochange, compare, history, increments
from riskloom.plans.views import Tables


def test_dependencies_are_counted_by_number_and_once(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 5), (2, 5), (3, 6), (3, 6), (4, 5), (9, 5)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    deps = Tables(spark, str(tmp_path)).dependencies()
    assert {(r.src, r.dst, r.w) for r in deps.collect()} == {("C7", "S5", 2), ("C8", "S6", 2), (None, "S5", 1)}
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    grouped = [line for line in plan(deps).splitlines() if "Aggregate(" in line]
    assert grouped and not any("concat" in line for line in grouped)
    labels = spark.createDataFrame([("C7", 1), ("C8", 1), ("S5", 2), ("S6", 1)], "path string, label int")
    flow = compare.cluster_deps(deps, labels)
    assert {tuple(r) for r in flow.collect()} == {(1, 2, 2), (1, 1, 2)}
    given = spark.createDataFrame([("C7", "S5", 3), ("C7", "S5", 1), ("C9", "S5", 1)], "src string, dst string, w bigint")
    flow = compare.cluster_deps(given, labels)
    assert {tuple(r) for r in flow.collect()} == {(1, 2, 4)}
    assert sum("Aggregate(" in line for line in plan(flow).splitlines()) == 2


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_pairs_of_a_commit_come_from_its_array(spark):
    rng = random.Random(3)
    commits = {c: set(rng.choices(range(40), k=rng.randint(1, 6))) for c in range(60)} | {99: set(range(40)), 98: set(range(0, 40, 2))}
    rows = [(c, f) for c, fs in commits.items() for f in fs] + [(None, 1), (None, 2), (5, None)]
    touched = spark.createDataFrame(rows, "commit bigint, file_id bigint").repartition(3)
    want = collections.Counter(p for fs in commits.values() for p in itertools.combinations(sorted(fs), 2))
    for chunk in (1, 7, 512):
        assert {(r.a, r.b): r.w for r in cochange.cochange(touched, chunk=chunk).collect()} == dict(want)
    # no touch is joined with another where no commit is larger than a chunk; one join looks for such commits
    assert sum("Join" in line for line in plan_of(cochange.cochange(touched)).splitlines()) <= 1
    assert cochange.cochange(touched.limit(0)).collect() == []


def test_an_increment_is_summed_once(spark):
    old = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "commit bigint, file_id bigint")
    new = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 4)], "commit bigint, file_id bigint")
    both = increments.delta(new, old)
    assert {tuple(r) for r in both.collect()} == {(2, 4, 1), (2, 3, -1)}
    assert "count(1)" not in plan_of(both)
    assert {tuple(r) for r in increments.delta(old).collect()} == {(1, 2, 1), (2, 3, 1)}
    assert "sum(w" not in plan_of(increments.delta(old))


def test_candidates_of_issues_are_not_held(spark):
    commits = spark.createDataFrame([(1, "fix abc-1, abc-1 and abc-12"), (1, "fix abc-1, abc-1 and abc-12"), (2, "none"), (3, "ABC#12"), (4, None)], "commit bigint, message string")
    issues = spark.createDataFrame([("ABC-1",), ("ABC-1",), ("ABC-12",), ("XYZ-1",)], "issue_key string")
    hits = history.issue_hits(commits, issues)
    assert sorted(tuple(r) for r in hits.collect()) == [(1, "ABC-1"), (1, "ABC-12"), (3, "ABC-1"), (3, "ABC-12")]
    assert not any("Aggregate" in line and "commit" in line and "tail" in line for line in plan_of(hits).splitlines())
    assert tuple(history.issue_counts(commits, issues).first()) == (3, 2)
