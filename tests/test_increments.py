"""A matrix kept up by increments, and by a stream of log files, against the matrix of the whole."""

import random

from pyspark.sql import functions as F

from riskloom.operators import cochange, history, increments, paths
from riskloom.sources import scans
from riskloom.streaming import log


def rows_of(df):
    return sorted(tuple(r) for r in df.select("a", "b", "w").collect())


def touched(spark, commits):
    return spark.createDataFrame([(c, f) for c, files in commits.items() for f in set(files)], "commit STRING, file_id BIGINT")


def test_increments_equal_the_whole(spark, tmp_path):
    rng = random.Random(4)
    old = {f"c{i}": rng.choices(range(30), k=rng.randint(1, 6)) for i in range(80)}
    new = {c: f for c, f in old.items() if rng.random() < 0.7} | {f"d{i}": rng.choices(range(40), k=rng.randint(1, 6)) for i in range(40)}
    for c in list(new)[:10]:
        new[c] = rng.choices(range(40), k=5)  # the same commit with other files
    path = f"{tmp_path}/matrix"
    first, second = touched(spark, old), touched(spark, new)
    increments.put(increments.delta(first), path, 0)
    assert rows_of(increments.matrix(spark, path)) == rows_of(cochange.cochange(first))
    added, dropped = increments.changes_between(first, second)
    assert added.select("commit").distinct().count() < len(new)
    for _ in range(2):  # written twice, counted once
        increments.put(increments.delta(added, dropped), path, 1)
    want = rows_of(cochange.cochange(second))
    assert rows_of(increments.matrix(spark, path)) == want
    assert rows_of(increments.matrix(spark, increments.compact(spark, path))) == want
    nothing = touched(spark, {"x": [1]}).limit(0)
    increments.put(increments.delta(nothing, nothing), path, 2)
    assert rows_of(increments.matrix(spark, path)) == want


def block(i, files):
    lines = "\n".join(f"{n}\t1\t{f}" for n, f in enumerate(files))
    return f"commit-block:\ncommit-hash:h{i}||message:m {i}||__unique-date-mark:2020-01-02T03:04:05+00:00||commiter:x||\n\n{lines}\n"


def test_stream_of_log_files(spark, tmp_path):
    rng = random.Random(9)
    names = [f"src/a/F{i}.java" for i in range(12)]
    files = spark.createDataFrame([(i, f"root/{n}") for i, n in enumerate(names)], "file_id BIGINT, path STRING")
    folder, stored, checkpoint = tmp_path / "log", f"{tmp_path}/stored", f"{tmp_path}/checkpoint"
    folder.mkdir()
    number = 0

    def add_files(n):
        nonlocal number
        for _ in range(n):
            text = "".join(block(f"{number}-{k}", rng.sample([*names, "other.txt"], 4)) for k in range(7))
            (folder / f"log{number}.txt").write_text(text + ("commit-block:\nbroken\n" if number == 1 else ""))
            number += 1

    def whole():
        commits = history.parse_blocks(scans.read_log_blocks(spark, str(folder)))
        return rows_of(cochange.cochange(cochange.touches(paths.resolve_changes(history.changed_files(commits, "strict"), files))))

    for n in (3, 0, 2):
        add_files(n)
        assert rows_of(log.keep_cochange(spark, str(folder), files, stored, checkpoint, files_at_once=2)) == whole()
    parts = spark.read.parquet(stored).select(F.col("part")).distinct().count()
    assert parts == 3  # two, one, and two files at once


def test_first_record_in_issue_order_is_kept(spark):
    commits = spark.createDataFrame(
        [("c1", "see B-2", 5), ("c1", "see B-1", 9), ("c1", "no issue", 1), ("c2", "B-2 again", 3), ("c2", "B-2 twice", 2), ("c3", "nothing", 0)],
        "commit STRING, message STRING, pos BIGINT",
    )
    issues = spark.createDataFrame([("B-1", 1), ("B-2", 0)], "issue_key STRING, pos BIGINT")
    got = {r.commit: r.message for r in history.match_issues(commits, issues).collect()}
    assert got == {"c1": "see B-2", "c2": "B-2 twice"}
    by_key = {r.commit: r.message for r in history.match_issues(commits, issues.drop("pos")).collect()}
    assert by_key == {"c1": "see B-1", "c2": "B-2 twice"}
