"""Log parsing, issue matching, release difference and path resolution on small literals."""

import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import history, paths
from riskloom.sources import scans

LOG = (
    "commit-block:commit-hash:a1||message:PROJ-1 fix||__unique-date-mark:2020-01-01T10:00:00+08:00||commiter:Bob||\n"
    "\n"
    "1\t2\tsrc/A.java\n"
    "-\t-\tx/img.png\n"
    "\n"
    "commit-block:commit-hash:a2||message:merge||__unique-date-mark:2020-01-02T10:00:00+08:00||commiter:Bob||\n"
)


@pytest.fixture
def log_path(tmp_path):
    f = tmp_path / "log.txt"
    f.write_text(LOG)
    return str(f)


def test_parse_log(spark, log_path):
    rows = {r.commit: r for r in history.parse_blocks(scans.read_log_blocks(spark, log_path)).collect()}
    assert sorted(rows) == ["a1", "a2"]
    a1 = rows["a1"]
    assert (a1.commiter, a1.message) == ("Bob", "PROJ-1 fix")
    assert a1.date == datetime.datetime(2020, 1, 1, 10)
    assert [tuple(p) for p in a1.paths] == [("1", "2", "src/A.java"), ("-", "-", "x/img.png")]
    assert rows["a2"].paths == []


def test_malformed_block_is_dropped_or_stops(spark, tmp_path):
    good = "commit-block:commit-hash:{0}||message:m||__unique-date-mark:2020-01-01T10:00:00+08:00||commiter:B||\n\n1\t1\ta.java\n"
    f = tmp_path / "log.txt"
    f.write_text(good.format("x1") + "commit-block:commit-hash:broken\n" + good.format("x2"))
    blocks = scans.read_log_blocks(spark, str(f))
    assert {r.commit for r in history.parse_blocks(blocks).collect()} == {"x1", "x2"}
    assert {r.commit for r in history.parse_blocks(blocks, strict_prefix=True).collect()} == {"x1"}
    assert tuple(history.malformed_blocks(blocks).first()) == (1, 3)


MESSAGES = ["PROJ-12 fix", "proj_123: x", "see PROJ 7", "no key", "xPROJ-12", "HBASE-7 and PROJ-7", "PROJ-1", None, "PROJ-12\nrest"]
KEYS = ["PROJ-12", "PROJ-7", "HBASE-7", "PROJ-12", "NONE-1"]


def test_messages_keep_other_line_ends(spark):
    block = "commit-hash:{0}||message:a{1}b||__unique-date-mark:2020-01-01T10:00:00+08:00||commiter:B||\n\n1\t1\ta.java\n"
    ends = ["\r", "\u0085", "\u2028", "\u2029"]
    blocks = spark.createDataFrame([(block.format(i, e), i) for i, e in enumerate(ends)], "block STRING, pos INT")
    got = {int(r.commit): (r.message, len(r.paths)) for r in history.parse_blocks(blocks).collect()}
    assert got == {i: (f"a{e}b", 1) for i, e in enumerate(ends)}


def test_issue_matching_equals_regex(spark):
    commits = spark.createDataFrame(list(enumerate(MESSAGES)), "commit BIGINT, message STRING")
    issues = spark.createDataFrame([(k,) for k in KEYS], "issue_key STRING")
    want = {
        (i, k) for i, m in enumerate(MESSAGES) for k in KEYS
        if m and re.search(".".join(k.split("-")[:2]), m, re.IGNORECASE)
    }
    assert {(r.commit, r.issue_key) for r in history.issue_hits(commits, issues).collect()} == want
    assert {r.commit for r in history.match_issues(commits, issues).collect()} == {i for i, _ in want}
    exact = {(r.commit, r.issue_key) for r in history.issue_hits(commits, issues, exact=True).collect()}
    assert exact == {(0, "PROJ-12"), (2, "PROJ-7"), (5, "PROJ-7"), (5, "HBASE-7"), (8, "PROJ-12")}
    counts = history.issue_counts(commits, issues).first()
    # a repeated issue row counts again
    assert (counts.issues_matched, counts.fix_commits) == (4, len({i for i, _ in want}))


def test_release_diff(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), ("d", 5)], "commit STRING, x INT")
    old = spark.createDataFrame([("c", 9), ("c", 8), ("z", 7)], "commit STRING, x INT")
    assert sorted(tuple(r) for r in history.release_diff(new, old).collect()) == [("a", 1), ("d", 5)]
    row = history.history_summary(new, old, new.filter("x < 2"), old.filter("x < 0")).first()
    assert tuple(row) == (5, 3, 2, 1, 0, 1)


def test_java_filters(spark):
    df = spark.createDataFrame([("a.java",), ("a-java",), ("java",), ("b.md",), (None,)], "path STRING")
    got = df.select(C.is_java_strict(F.col("path")), C.is_java_loose(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False), (False, False), (None, True)]


def test_path_resolution_equals_substring_search(spark):
    rng = random.Random(4)
    parts = ["a", "ab", "src", "B", "org", "A.java", "BA.java", "A.javax"]
    files = [(i, "/root/" + "/".join(rng.choices(parts, k=rng.randint(1, 5)))) for i in range(40)]
    logs = {"/".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(40)} | {"a", "x", "A.java", "/root/" * 20}
    want = {}
    for p, (i, f) in itertools.product(logs, files):
        if p in f:
            want.setdefault(p, []).append(i)
    got = paths.resolve_paths(
        spark.createDataFrame([(p,) for p in logs], "log_path STRING"), spark.createDataFrame(files, "file_id BIGINT, path STRING")
    ).collect()
    assert {r.log_path: (r.file_id, r.candidates) for r in got} == {p: (min(v), len(v)) for p, v in want.items()}


def test_identifier_split_and_numbers(spark):
    df = spark.createDataFrame([("parseHTTPResponse2_fast", "Total classes: 12\nx: 3 y")], "s STRING, t STRING")
    words, numbers = df.select(C.split_identifier(F.col("s")), C.printed_numbers(F.col("t"))).first()
    assert words == ["parse", "HTTP", "Response", "2", "fast"]
    assert numbers == [12, 3]


def test_directory_group(spark):
    names = ["/root/p/core/src/main/A.java", "/root/p/x/org/b/A.java", "/root/p/A.java", "/root/p/src/A.java"]
    df = spark.createDataFrame([(n,) for n in names], "path STRING")
    got = [r[0] for r in df.select(C.directory_group(F.col("path"), "/root/p/")).collect()]
    assert got == ["core", "x.", "root", "root"]
