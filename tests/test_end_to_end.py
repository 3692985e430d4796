"""From log text and issue list to the two reports."""

from pyspark.sql import functions as F

from riskloom.operators import cochange, hierarchy, history, hotspots, paths
from riskloom.plans import pipelines
from riskloom.sources import scans


def block(commit, message, *changes):
    lines = "".join(f"{i}\t{d}\t{p}\n" for i, d, p in changes)
    return f"commit-block:commit-hash:{commit}||message:{message}||__unique-date-mark:2020-01-01T10:00:00+08:00||commiter:B||\n\n{lines}\n"


def test_log_to_reports(spark, tmp_path):
    names = [f"/root/p/src/{m}/F{i}.java" for m in "xy" for i in range(4)]
    x, y = [n.removeprefix("/root/p/") for n in names[:4]], [n.removeprefix("/root/p/") for n in names[4:]]
    old = (
        block("c1", "P-1 fix", (1, 1, x[0]), (2, 0, x[1]), ("-", "-", "logo.png"))
        + block("c2", "p-1 again", (1, 0, x[0]), (1, 1, x[1]))
        + block("c3", "P-2: cross", (4, 4, x[0]), (1, 0, y[0]))
        + block("c4", "feature", (9, 9, y[1]), (1, 0, y[2]))
        + block("c5", "feature", (9, 9, y[1]), (1, 0, y[2]), (1, 1, y[3]), (3, 3, x[2]), (3, 3, x[3]))
    )
    new = old + block("d1", "P-3 fix", (5, 0, x[0])) + block("d2", "P-2 both", (1, 0, x[1]), (1, 0, y[1]))
    (tmp_path / "old.txt").write_text(old)
    (tmp_path / "new.txt").write_text(new)
    (tmp_path / "files.csv").write_text("\n".join(names) + "\n")
    (tmp_path / "issues.csv").write_text("Issue Type,Issue key\nBug,P-1\nBug,P-2\nBug,P-3\n")

    files = scans.read_file_list(spark, str(tmp_path / "files.csv")).cache()
    issues = scans.read_issues(spark, str(tmp_path / "issues.csv"))
    v1, v2 = (history.parse_blocks(scans.read_log_blocks(spark, str(tmp_path / f"{v}.txt"))).cache() for v in ("old", "new"))
    f1, f2 = history.match_issues(v1, issues), history.match_issues(v2, issues)
    assert tuple(history.history_summary(v2, v1, f2, f1).first()) == (7, 5, 2, 5, 3, 2)

    def resolved(commits, java):
        return hotspots.with_churn(paths.resolve_changes(history.changed_files(commits, java), files))

    touched = cochange.touches(resolved(v1, "strict")).cache()
    assert {(r.a, r.b): r.w for r in cochange.cochange(touched).collect()}[5, 6] == 2
    vectors = files.select("file_id", F.when(F.col("path").contains("/x/"), F.array(F.lit(1.0), F.col("file_id") / 100)).otherwise(
        F.array(F.col("file_id") / 100, F.lit(1.0))).alias("vec"))
    loc = files.select("file_id", (10 + F.col("file_id")).alias("loc"))
    tree = pipelines.dendrogram(vectors, loc, touched)
    assert tree.merges.count() == 7
    best = pipelines.select_clusters(tree)
    row = pipelines.result_row(best, "p", "1.0", 2.5)
    assert row.columns == ["project", "version", "file_sum", "iteration", "f_optimal", "run_time"]
    labels = hierarchy.cut(tree.merges, tree.leaves, [2]).select("file_id", "label").cache()
    assert {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 4, 1: 4}

    fixes = resolved(f1, "loose")
    risk = pipelines.rank_risk(fixes, labels, loc)
    assert {r.file_id: r.bugs for r in risk.space.collect()} == {0: 3, 1: 2}
    report = hotspots.risk_report(fixes, labels, loc, risk.decision, risk.top, "p").first()
    assert (report.bf_in, report.bf_out, report.top_buggy_cluster) == (2, 1, [0])
    stored = spark.createDataFrame([("p", report.top_buggy_cluster)], "project STRING, top_buggy_cluster ARRAY<INT>")
    top = hotspots.stored_top(stored, "p")
    later = hotspots.next_release_report(resolved(history.release_diff(f2, f1), "loose"), labels, top, "p").first()
    assert (later.bf_in, later.bf_out, later.bc_top) == (1, 1, 5 / 7)
