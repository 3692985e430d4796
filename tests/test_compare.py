"""Comparison operators and cluster folders against brute force."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import compare
from riskloom.operators.matching import matching_size


def place(files):
    """Copy files one by one into the folders of their clusters."""
    taken, out = set(), {}
    for file_id, path, label in sorted(files):
        name = os.path.basename(path)
        stem, ext = os.path.splitext(name)
        target, i = name, 0
        while (label, target) in taken:
            i += 1
            target = f"{stem}_{i}{ext}"
        taken.add((label, target))
        out[file_id] = target
    return out


@pytest.mark.parametrize("seed,names", [
    (1, ["A.java", "B.java", "README", ".x"]),
    (2, ["A.java", "A_1.java", "A_2.java", "A_1_1.java", "A_4.java", "B_1.java"]),
    (3, ["A", "A_1", "A_2", "A_3", "A_1_2", "A_01"]),
])
def test_cluster_folders(spark, seed, names):
    rng = random.Random(seed)
    files = [(i, f"src/{rng.choice('xy')}/{rng.choice(names)}", rng.randint(0, 1)) for i in range(45)]
    got = compare.cluster_layout(spark.createDataFrame(files, "file_id BIGINT, path STRING, label INT")).collect()
    assert {r.file_id: r.target for r in got} == place(files)


def test_cliffs_delta(spark):
    rng = random.Random(2)
    a = {m: [rng.randint(0, 9) for _ in range(20)] for m in "xy"}
    b = {m: [rng.randint(2, 11) for _ in range(15)] for m in "xy"}
    rows = [(m, "a", float(v)) for m in a for v in a[m]] + [(m, "b", float(v)) for m in b for v in b[m]]
    got = {r.method: r for r in compare.cliffs_delta(spark.createDataFrame(rows, "method STRING, side STRING, value DOUBLE")).collect()}
    for m in "xy":
        want = sum((x > y) - (x < y) for x, y in itertools.product(a[m], b[m])) / 300
        assert got[m].delta == pytest.approx(want)
        size = abs(want)
        word = "negligible" if size < 0.147 else "small" if size < 0.33 else "medium" if size < 0.474 else "large"
        assert got[m].magnitude == word and got[m].report == f"{round(want, 2)}({word[0]})"


def test_metric_table_average_takes_part(spark):
    rows = [("p1", "A", 0.111), ("p1", "B", 0.2), ("p2", "A", 0.333)]
    table = compare.metric_pivot(spark.createDataFrame(rows, "project STRING, method STRING, value DOUBLE"), ["A", "B"])
    assert {r.project: (r.A, r.B) for r in table.collect()} == {"p1": (0.11, 0.2), "p2": (0.33, None), "Average": (0.22, 0.2)}
    long = compare.delta_samples(table, "A", ["B"])
    assert long.filter("side = 'a'").count() == 3
    assert compare.delta_samples(table, "A", ["B"], drop_average=True).filter("side = 'a'").count() == 2


def test_modularity(spark):
    deps = [("f1", "f2", 3), ("f2", "f3", 2), ("f3", "f4", 1), ("f4", "f1", 5), ("f1", "zz", 9), ("f1", "f1", 1)]
    labels = [("f1", 0), ("f2", 0), ("f3", 1), ("f4", 1), ("f5", 2)]
    lifted = compare.cluster_deps(spark.createDataFrame(deps, "src STRING, dst STRING, w BIGINT"), spark.createDataFrame(labels, "path STRING, label INT"))
    assert {(r.src, r.dst): r.w for r in lifted.collect()} == {(0, 0): 4, (0, 1): 2, (1, 1): 1, (1, 0): 5}
    assert compare.mq(lifted).first().mq == pytest.approx(4 / (4 + 3.5) + 1 / (1 + 3.5))


def test_smell_jaccard_with_missing_keys(spark):
    schema = "project STRING, package STRING, type STRING, smell STRING, cause STRING, cluster INT, pos INT"
    per = [("0", "p", "T", "S", None, 0, 0), ("1", "p", "T", "S", None, 1, 0), ("1", "q", "T", "S", "c", 1, 1), ("1", "q", "T", "S", "c", 1, 2)]
    whole = [("all", "p", "T", "S", None, 9, 0), ("all", "r", "T", "S", "c", 9, 1)]
    chosen = spark.createDataFrame([("1",)], "project STRING")
    row = compare.smell_jaccard(spark.createDataFrame(whole, schema), spark.createDataFrame(per, schema), chosen).first()
    # the smell of both clusters belongs to cluster 0, which was not chosen
    assert (row.in_whole, row.in_chosen, row.shared, row.all_smells) == (2, 1, 0, 3)
    both = spark.createDataFrame([("0",), ("1",)], "project STRING")
    row = compare.smell_jaccard(spark.createDataFrame(whole, schema), spark.createDataFrame(per, schema), both).first()
    assert (row.in_chosen, row.shared, row.all_smells) == (2, 1, 3)


def set_partitions(n):
    if n == 0:
        yield []
        return
    for smaller in set_partitions(n - 1):
        yield smaller + [0 if not smaller else max(smaller) + 1]
        for g in range(max(smaller) + 1 if smaller else 0):
            yield smaller + [g]


def moves_and_joins(a, b):
    """Least moves plus joins that turn grouping a into b: best choice of a target per group."""
    groups = sorted(set(a))
    best = None
    for targets in itertools.product(sorted(set(b)), repeat=len(groups)):
        to = dict(zip(groups, targets))
        cost = sum(to[x] != y for x, y in zip(a, b)) + len(groups) - len(set(targets))
        best = cost if best is None else min(best, cost)
    return best


def test_mojofm_against_brute_force(spark):
    truth = [0, 0, 0, 1, 1, 2]
    furthest = max(moves_and_joins(p, truth) for p in set_partitions(6))
    for mine in ([0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 1, 2], [0, 1, 2, 0, 1, 2], [0, 0, 0, 0, 0, 0], [0, 1, 2, 3, 4, 5]):
        frame = lambda g: spark.createDataFrame([(str(i), f"g{x}") for i, x in enumerate(g)], "path STRING, grp STRING")
        row = compare.mojofm(compare.grouping_overlap(frame(mine), frame(truth))).first()
        assert row.max_distance == furthest
        assert row.moves + row.joins == moves_and_joins(mine, truth), mine
        assert row.mojofm == pytest.approx(round(100 * (1 - moves_and_joins(mine, truth) / furthest), 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_against_augmenting_paths(spark, seed):
    rng = random.Random(seed)
    edges = {(f"a{rng.randint(0, 14)}", f"b{rng.randint(0, 11)}") for _ in range(26)}
    held = {}

    def extend(a, seen):
        for x, b in sorted(edges):
            if x == a and b not in seen:
                seen.add(b)
                if b not in held or extend(held[b], seen):
                    held[b] = a
                    return True
        return False

    want = sum(extend(a, set()) for a in sorted({a for a, _ in edges}))
    assert matching_size(spark.createDataFrame(sorted(edges), "a STRING, b STRING")) == want


def test_size_split(spark):
    df = spark.createDataFrame([(f"p{i:02d}",) for i in range(13)], "project STRING")
    got = {r.project: r.size for r in compare.size_split(df, [F.col("project")]).collect()}
    assert [got[f"p{i:02d}"] for i in (0, 9, 10, 12)] == ["small", "small", "large", "large"]
