"""Scans and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.sources import scans, sinks


def test_project_list_with_byte_order_mark(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("﻿project,exp_version,exp_branch,new_version,new_branch,jira_key,jira_bugs_amount\nx,1.0,b1,2.0,b2,XX,12\n", encoding="utf-8")
    row = scans.read_projects(spark, str(f)).first()
    assert (row.project, row.exp_version, row.jira_bugs_amount) == ("x", "1.0", 12)


def test_commit_records_round_trip(spark, tmp_path):
    rec = [{"commit": "a", "commiter": "B", "date": "2020-01-01 10:00:00", "message": "m", "paths": [{"insertions": "1", "deletions": "-", "path": "x"}]}]
    f = tmp_path / "log.json"
    f.write_text(json.dumps(rec))
    commits = scans.read_commits(spark, str(f))
    assert commits.first().paths[0].deletions == "-"
    sinks.write_records(commits, str(tmp_path / "lines"))
    assert scans.read_commit_lines(spark, str(tmp_path / "lines")).collect() == commits.collect()


def test_headerless_tables(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("a/B.java,3\na/C.java,0\n")
    (tmp_path / "files.csv").write_text("a/B.java\na/C.java\na/A.java\n")
    (tmp_path / "loc.csv").write_text("Name,CountLineCode\na/B.java,10\na/C.java,\n")
    assert [tuple(r) for r in scans.read_labels(spark, str(tmp_path / "labels.csv")).collect()] == [("a/B.java", 3), ("a/C.java", 0)]
    files = scans.read_file_list(spark, str(tmp_path / "files.csv")).orderBy("file_id").collect()
    assert [tuple(r) for r in files] == [(0, "a/B.java"), (1, "a/C.java"), (2, "a/A.java")]
    assert [tuple(r) for r in scans.read_loc(spark, str(tmp_path / "loc.csv")).collect()] == [("a/B.java", 10)]


def test_matrix_round_trip(spark, tmp_path):
    ids = spark.range(4).select(F.col("id").alias("file_id"))
    edges = spark.createDataFrame([(0, 2, 3), (1, 2, 1)], "a BIGINT, b BIGINT, w BIGINT")
    sinks.write_matrix(edges, ids, str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(lines) == sorted(["0,0,3,0", "0,0,1,0", "3,1,0,0", "0,0,0,0"])
    (tmp_path / "m.csv").write_text("0,0,3,0\n0,0,1,0\n3,1,0,0\n0,0,0,0\n")
    back = scans.read_matrix(spark, str(tmp_path / "m.csv")).collect()
    assert sorted(tuple(r) for r in back) == [(0, 2, 3.0), (1, 2, 1.0)]


def test_token_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nfoo 1 2 3\nbar 0.5 0 -1\n")
    vectors = {r.token: r.vec for r in scans.read_token_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert vectors == {"foo": [1, 2, 3], "bar": [0.5, 0, -1]}
    folder = tmp_path / "tokens"
    folder.mkdir()
    (folder / "A.csv").write_text('package,Keyword\nx,Identifier\n"a ""b"", c",Comment\nfoo,Identifier\n')
    tokens = scans.read_tokens(spark, str(folder)).orderBy("pos").collect()
    assert [(r.pos, r.text, r.token_type) for r in tokens] == [
        (0, "package", "Keyword"), (1, "x", "Identifier"), (2, 'a "b", c', "Comment"), (3, "foo", "Identifier")]


def test_issue_parts_and_list(spark, tmp_path):
    head = ",".join(scans.ISSUE_COLUMNS)
    for i in (1, 2):
        (tmp_path / f"part{i}.csv").write_text(f'{head}\nBug,X-{i},{i},"sum, mary",,,,,,,,\n')
    merged = scans.merge_issue_parts(spark, [str(tmp_path / f"part{i}.csv") for i in (1, 2)])
    assert merged.columns == scans.ISSUE_COLUMNS
    assert sorted(r["Issue key"] for r in merged.collect()) == ["X-1", "X-2"]
    issues = scans.read_issues(spark, str(tmp_path / "part1.csv")).collect()
    assert [r.issue_key for r in issues] == ["X-1"]


def test_dependencies_smells_results(spark, tmp_path):
    (tmp_path / "d.csv").write_text("From File,To File,References,Other\na,b,3,9\n")
    assert tuple(scans.read_dependencies(spark, str(tmp_path / "d.csv")).first()) == ("a", "b", 3)
    for i in (0, 1):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "ds.csv").write_text(f"Project Name,Package Name,Type Name,Design Smell,Cause of the Smell,More\n{i},p,T,S,c,x\n")
    smells = scans.read_smells(spark, [str(tmp_path / str(i) / "ds.csv") for i in (0, 1)])
    assert sorted((r.cluster, r.project, r.cause) for r in smells.collect()) == [(0, "0", "c"), (1, "1", "c")]
    row = spark.createDataFrame([("x", [1, 11, 36])], "project STRING, top_buggy_cluster ARRAY<INT>")
    for _ in range(2):
        sinks.append_result(row, str(tmp_path / "results"))
    back = scans.read_results(spark, str(tmp_path / "results")).collect()
    assert [r.top_buggy_cluster for r in back] == [[1, 11, 36]] * 2


def test_rsf_and_folders(spark, tmp_path):
    df = spark.createDataFrame([("/r/a/B.java", 3)], "path STRING, label INT")
    rows = sinks.rsf_rows(df, F.col("label"), C.dotted_path(F.col("path"), "/r/"))
    sinks.write_rsf(rows, str(tmp_path / "rsf"))
    assert [r.value for r in spark.read.text(str(tmp_path / "rsf")).collect()] == ["contain 3 a.B.java"]
    sinks.write_cluster_folders(df, str(tmp_path / "folders"))
    assert (tmp_path / "folders" / "label=3").is_dir()
    sinks.write_table(df, str(tmp_path / "table"), header=False)
    assert [tuple(r) for r in scans.read_labels(spark, str(tmp_path / "table")).collect()] == [("/r/a/B.java", 3)]
    added = sinks.add_columns(df, {"v": F.lit(1), "label": F.col("label") + 1}).first()
    assert (added.v, added.label) == (1, 4)


def test_lines_of_code(spark):
    df = spark.createDataFrame([("a();\n\n  // no\n * no\n/* no\nb();  // yes\n",)], "t STRING")
    assert df.select(C.line_count(F.col("t"))).first()[0] == 2
    assert df.select(C.as_count(F.lit("-")), C.as_count(F.lit("12"))).first()[:] == (0, 12)
    assert df.select(C.round_even(F.lit(0.125)), C.round_even(F.lit(0.375))).first()[:] == pytest.approx((0.12, 0.38))
