"""Where bug fixes concentrate: bug space, cluster ranking, top clusters and the two reports.

``changes`` rows are changed files of bug-fix commits with a resolved file:
``commit, file_id, churn`` (churn = inserted + deleted lines). The ranking takes several projects at once:
``by`` names the columns, such as ``project``, that all its tables carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import scoring
from riskloom.operators.ordering import running_totals
from riskloom.runtime import attach, scalar_struct, settle

BUG_CRITERIA = ["bug_weight", "bug_density_file", "bug_density_loc"]


def with_churn(changes: DataFrame) -> DataFrame:
    """``churn`` from the two numstat fields; a binary file has none."""
    churn = C.as_count(F.col("insertions").cast("string")) + C.as_count(F.col("deletions").cast("string"))
    return changes.withColumn("churn", churn)


def bug_space(changes: DataFrame, labels: DataFrame, min_bugs: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Files with at least ``min_bugs`` changed-file rows in bug-fix commits.

    Rows count, not commits: a file listed twice by one commit counts twice.
    """
    bugs = changes.groupBy(*by, "file_id").agg(F.count(F.lit(1)).alias("bugs")).filter(F.col("bugs") >= min_bugs)
    return labels.join(bugs, [*by, "file_id"])


def bug_decision(space: DataFrame, clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of bugs, bugs per file and bugs per line of each cluster that has bugs.

    ``clusters`` needs ``label, in_file, in_loc``.
    """
    per_label = space.groupBy(*by, "label").agg(
        F.sum("bugs").alias("bugs"), F.count(F.lit(1)).alias("bug_files")
    )
    totals = space.groupBy(*by).agg(F.sum("bugs").alias("n"))
    sized = per_label.join(clusters.select(*by, "label", "in_file", "in_loc"), [*by, "label"])
    return attach(sized, totals, "_t", by).select(
        *by,
        "label",
        C.ratio(F.col("bugs"), F.col("_t.n")).alias("bug_weight"),
        C.ratio(F.col("bugs"), F.col("in_file")).alias("bug_density_file"),
        C.ratio(F.col("bugs"), F.col("in_loc")).alias("bug_density_loc"),
        "bug_files",
    )


def rank_clusters(decision: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scale the bug criteria, weigh them by entropy and add ``score`` (best first = highest)."""
    scaled = scoring.minmax_scale(decision, {c: "pos" for c in BUG_CRITERIA}, by=by)
    weights = scoring.entropy_weights_row(scaled, BUG_CRITERIA, by)
    return scoring.weighted_sum(scaled, BUG_CRITERIA, weights, by=by)


def top_clusters(ranked: DataFrame, share: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """Best-ranked clusters until their bug-space files reach ``share`` of all; ties by label.

    The cluster that crosses the threshold is included. Result: ``label, rank, running,
    threshold, bug_space_files``.
    """
    placed = running_totals(
        ranked, [*[F.col(c) for c in by], F.col("score").desc(), F.col("label").asc()], {"running": "bug_files"}
    )
    # ranks and sums run over all groups, one after the other; each starts anew at its first row
    if by:
        placed = settle(placed)
    groups = placed.groupBy(*by).agg(
        F.sum("bug_files").alias("files"), F.min(F.col("running") - F.col("bug_files")).alias("before"), F.min("rank").alias("first")
    )
    threshold = F.round(F.col("_g.files") * F.lit(share)).cast("bigint")
    return (
        attach(placed, groups, "_g", by)
        .withColumn("running", F.col("running") - F.col("_g.before"))
        .withColumn("rank", F.col("rank") - F.col("_g.first") + 1)
        .withColumn("bug_space_files", F.col("_g.files"))
        .withColumn("threshold", threshold)
        .filter((F.col("running") - F.col("bug_files") < F.col("threshold")) | (F.col("rank") == 1))
        .select(*by, "label", "rank", "running", "threshold", "bug_space_files")
    )


def fix_clusters(changes: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per fix and touched cluster: ``commit, label, churn``."""
    per_file = changes.groupBy(*by, "commit", "file_id").agg(F.sum("churn").alias("churn"))
    return (
        per_file.join(labels.select(*by, "file_id", "label"), [*by, "file_id"])
        .groupBy(*by, "commit", "label")
        .agg(F.sum("churn").alias("churn"))
    )


def fixes(per_cluster: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per fix: number of clusters touched, the first of them and the churn."""
    return per_cluster.groupBy(*by, "commit").agg(
        F.count(F.lit(1)).alias("clusters"), F.min("label").alias("label"), F.sum("churn").alias("churn")
    )


def fix_locality(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster: fixes that stay inside it; and overall ``bf_in`` and ``bf_out``."""
    inside = F.col("clusters") == 1
    # the fixes that leave their cluster are the group without a label
    counts = settle(
        fixes(fix_clusters(changes, labels))
        .groupBy(F.when(inside, F.col("label")).alias("label"))
        .agg(F.count(F.lit(1)).alias("bf"))
    )
    stays = F.col("label").isNotNull()
    zero = F.lit(0).cast("bigint")
    totals = counts.agg(
        F.coalesce(F.sum(F.when(stays, F.col("bf"))), zero).alias("bf_in"),
        F.coalesce(F.sum(F.when(~stays, F.col("bf"))), zero).alias("bf_out"),
    )
    return counts.filter(stays).withColumn("_t", scalar_struct(totals)).select("label", "bf", "_t.bf_in", "_t.bf_out")


def churn_by_cluster(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """Changed lines of all fixes per cluster."""
    return (
        changes.groupBy("file_id")
        .agg(F.sum("churn").alias("churn"))
        .join(labels.select("file_id", "label"), "file_id")
        .groupBy("label")
        .agg(F.sum("churn").alias("churn"))
    )


def _top_list(top: DataFrame):
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label")))
    return F.transform(ordered, lambda x: x["label"]).alias("top_buggy_cluster")


def risk_reports(
    changes: DataFrame, labels: DataFrame, loc: DataFrame, decision: DataFrame, top: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """How much of the files, lines, churn and fixes the top clusters hold, a row for each project of ``by`` that has labels.

    ``decision`` holds the criteria as counted, not scaled, and ``top`` is the result of ``top_clusters``; a project
    without them holds nothing in them.
    """
    key, zero = [*by, "label"], F.lit(0).cast("bigint")
    per_cluster = settle(fix_clusters(changes, labels, by))
    fixed = fixes(per_cluster, by)
    inside = F.col("clusters") == 1
    fix_totals = fixed.groupBy(*by).agg(
        F.count_if(inside).alias("bf_in"), F.count_if(~inside).alias("bf_out"), F.sum("churn").alias("churn")
    )
    files = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("files"))
    lines = labels.join(loc, [*by, "file_id"]).groupBy(*key).agg(F.sum("loc").alias("loc"))
    bf = fixed.filter(inside).groupBy(*key).agg(F.count(F.lit(1)).alias("bf"))
    bc = per_cluster.groupBy(*key).agg(F.sum("churn").alias("bc"))
    densities = decision.select(*key, "bug_density_file", "bug_density_loc")
    whole = (
        files.join(lines, key, "left").join(bf, key, "left").join(bc, key, "left")
        .join(densities, key, "left")
        .join(top.select(*key, "rank", "running", "threshold", "bug_space_files"), key, "left")
    )
    is_top = F.col("rank").isNotNull()
    pick = lambda c: F.sum(F.when(is_top, F.coalesce(c, F.lit(0))))
    sums = whole.groupBy(*by).agg(
        (F.max("label") + 1).cast("bigint").alias("cluster_sum"),
        F.sum("files").alias("file_sum"),
        F.sum("loc").alias("loc_sum"),
        F.max("bug_space_files").alias("file_bs"),
        F.max("threshold").alias("buggy_file_threshold"),
        F.max("running").alias("current_accumulate_file"),
        pick("files").alias("file_in_top_cluster"),
        pick("loc").alias("loc_top"),
        pick("bf").alias("bf_top"),
        pick("bc").alias("bc_top"),
        F.avg(F.when(is_top, F.col("bug_density_file"))).alias("bug_density_file_average"),
        F.avg(F.when(is_top, F.col("bug_density_loc"))).alias("bug_density_loc_average"),
    )
    row = attach(attach(sums, fix_totals, "_f", by), top.groupBy(*by).agg(_top_list(top)), "_l", by)
    bf_in, bf_out = F.coalesce("_f.bf_in", zero), F.coalesce("_f.bf_out", zero)
    return row.select(
        *by,
        "cluster_sum",
        "file_bs",
        "file_sum",
        C.ratio(F.col("file_bs"), F.col("file_sum")).alias("file_bs_share"),
        bf_in.alias("bf_in"),
        bf_out.alias("bf_out"),
        C.ratio(F.col("file_in_top_cluster"), F.col("file_sum")).alias("fr"),
        C.ratio(F.col("loc_top"), F.col("loc_sum")).alias("loc"),
        C.ratio(F.col("bc_top"), F.col("_f.churn")).alias("bc"),
        C.ratio(F.col("bf_top"), bf_in + bf_out).alias("bfr"),
        "bug_density_file_average",
        "bug_density_loc_average",
        C.ratio(F.col("bf_top"), F.col("file_in_top_cluster")).alias("density_bf_file"),
        C.ratio(F.col("bf_top"), F.col("loc_top")).alias("density_bf_loc"),
        C.ratio(F.col("bf_top"), bf_in).alias("bfin_bfr"),
        "buggy_file_threshold",
        "current_accumulate_file",
        "file_in_top_cluster",
        F.col("_l.top_buggy_cluster").alias("top_buggy_cluster"),
    )


def risk_report(
    changes: DataFrame, labels: DataFrame, loc: DataFrame, decision: DataFrame, top: DataFrame, project: str
) -> DataFrame:
    """The row of one project, with its name."""
    return risk_reports(changes, labels, loc, decision, top).select(F.lit(project).alias("project"), "*")


def stored_top(results: DataFrame, project: str) -> DataFrame:
    """Top clusters of a project from stored reports, ``label, rank``."""
    listed = results.filter(F.col("project") == project).select(F.posexplode("top_buggy_cluster").alias("at", "label"))
    return listed.select("label", (F.col("at") + 1).alias("rank"))


_HELD = ["cluster_sum", "file_sum", "bf_in", "bf_out", "bc_top", "bc_all", "bfr_top", "bfr_all", "bftop_in_bfin"]


def next_release_reports(changes: DataFrame, labels: DataFrame, top: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How the clusters chosen on one release hold the fixes of the next, a row for each project of ``by`` that has labels.

    Churn is credited to a cluster only by fixes that stay inside it; the total counts all fixes.
    """
    fixed = fixes(fix_clusters(changes, labels, by), by).join(
        top.select(*by, "label", F.lit(True).alias("is_top")), [*by, "label"], "left"
    )
    inside = F.col("clusters") == 1
    in_top = inside & F.col("is_top").isNotNull()
    zero = F.lit(0).cast("bigint")
    sums = fixed.groupBy(*by).agg(
        F.count_if(inside).alias("bf_in"),
        F.count_if(~inside).alias("bf_out"),
        F.count_if(in_top).alias("bf_top"),
        F.sum(F.when(inside, F.col("churn")).otherwise(zero)).alias("bc_in"),
        F.sum(F.when(in_top, F.col("churn")).otherwise(zero)).alias("bc_in_top"),
        F.sum("churn").alias("bc"),
    )
    sizes = labels.groupBy(*by).agg(
        (F.max("label") + 1).cast("bigint").alias("cluster_sum"), F.count(F.lit(1)).alias("file_sum")
    )
    if by:  # a project without fixes has a row as well
        sums = sizes.join(sums, list(by), "left").withColumns({c: F.coalesce(c, zero) for c in ("bf_in", "bf_out", "bf_top")})
    else:
        sums = attach(sums, sizes, "_s").select("*", "_s.*")
    all_fixes = F.col("bf_in") + F.col("bf_out")
    rates = {
        "bc_top": C.ratio(F.col("bc_in_top"), F.col("bc")), "bc_all": C.ratio(F.col("bc_in"), F.col("bc")),
        "bfr_top": C.ratio(F.col("bf_top"), all_fixes), "bfr_all": C.ratio(F.col("bf_in"), all_fixes),
        "bftop_in_bfin": C.ratio(F.col("bf_top"), F.col("bf_in")),
    }
    return sums.withColumns(rates).select(*by, *_HELD)


def next_release_report(changes: DataFrame, labels: DataFrame, top: DataFrame, project: str) -> DataFrame:
    """The row of one project, with its name."""
    return next_release_reports(changes, labels, top).select(F.lit(project).alias("project"), *_HELD)
