"""Commit log: parsing, bug-fix commits by issue key, and the difference of two releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.runtime import store

# The field markers of the log format. A field may hold no line feed; (?d) lets it hold other line ends.
_FIELDS = {
    "commit": r"(?d)commit-hash:(.*)\|\|message",
    "message": r"(?d)message:(.*)\|\|__unique-date-mark",
    "date": r"(?d)__unique-date-mark:(.*)\|\|commiter",
    "commiter": r"(?d)commiter:(.*)\|\|",
}


def parse_blocks(blocks: DataFrame, strict_prefix: bool = False) -> DataFrame:
    """Blocks ``(block, pos)`` -> ``commit, commiter, date, message, paths``.

    A block is well formed if each header field occurs in it exactly once. Malformed blocks are
    left out; with ``strict_prefix`` everything from the first malformed block on is left
    out, which is what a reader that stops there would give.
    """
    found = F.struct(
        *[F.regexp_extract_all("block", F.lit(rx), 1).alias(name) for name, rx in _FIELDS.items()],
        F.split("block", "\n").alias("lines"),
    )
    # generated rather than projected, so that a filter on a field does not repeat the matching
    parsed = blocks.select("pos", F.inline(F.array(found)))
    well_formed = F.lit(True)
    for name in _FIELDS:
        well_formed = well_formed & (F.size(name) == 1)
    if strict_prefix:
        first_bad = parsed.filter(~well_formed).agg(F.min("pos").alias("p")).scalar()
        parsed = parsed.withColumn("_stop", first_bad).filter(
            F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))
        )
    # numstat lines: the third line of the block onward
    numstat = F.filter(F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0))), lambda x: F.trim(x) != "")
    fields = F.transform(numstat, lambda line: F.split(F.rtrim(line, F.lit("\r")), "\t"))
    change = F.transform(
        fields,
        lambda f: F.struct(
            F.get(f, F.lit(0)).alias("insertions"),
            F.get(f, F.lit(1)).alias("deletions"),
            F.replace(F.get(f, F.lit(2)), F.lit("\\"), F.lit("/")).alias("path"),
        ),
    )
    return parsed.filter(well_formed).select(
        F.col("commit")[0].alias("commit"),
        F.col("commiter")[0].alias("commiter"),
        # the trailing UTC offset (6 characters) is dropped, not applied
        F.expr("try_cast(substring(date[0], 1, length(date[0]) - 6) AS TIMESTAMP_NTZ)").alias("date"),
        F.col("message")[0].alias("message"),
        change.alias("paths"),
    )


def malformed_blocks(blocks: DataFrame) -> DataFrame:
    """Number of blocks whose header fields do not occur exactly once each."""
    bad = F.lit(False)
    for rx in _FIELDS.values():
        bad = bad | (F.size(F.regexp_extract_all("block", F.lit(rx), 1)) != 1)
    return blocks.agg(F.count_if(bad).alias("malformed"), F.count(F.lit(1)).alias("blocks"))


def changed_files(commits: DataFrame, java: str | None = None) -> DataFrame:
    """One row per changed file: ``commit, pos, insertions, deletions, path``.

    ``java="strict"`` keeps the java files that co-change is counted on, ``java="loose"`` those that
    bug fixes are counted on; see the two filters in ``functions.columns``.
    """
    rows = commits.select("commit", F.posexplode("paths").alias("pos", "p")).select(
        "commit", "pos", "p.insertions", "p.deletions", "p.path"
    )
    if java is None:
        return rows
    return rows.filter({"strict": C.is_java_strict, "loose": C.is_java_loose}[java](F.col("path")))


def issue_hits(commits: DataFrame, issues: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct ``(commit, issue_key)`` where the message names the issue.

    A key ``ABC-12`` matches, ignoring case, wherever the message has ``abc``, any one
    character and ``12`` in a row; a longer number with the same start matches too. With
    ``exact`` the named key must not continue in letters or digits on either side.

    A message yields all windows that are as long as a head and are one; each yields one candidate per
    tail length in use. The candidates meet the keys in an equi-join, so no message is compared with every key.
    """
    return _named(commits, issues, exact).distinct()


def _named(commits: DataFrame, issues: DataFrame, exact: bool) -> DataFrame:
    """``(commit, issue_key)`` of ``issue_hits``, once for each place that names the issue: candidates go to the join as they are, none is held to be compared."""
    parts = F.split(F.lower("issue_key"), "-")
    keys = (
        issues.select("issue_key")
        .distinct()
        .select("issue_key", parts[0].alias("head"), F.get(parts, F.lit(1)).alias("tail"))
        .filter(F.col("tail").isNotNull())
    )
    heads = store(
        keys.groupBy("head").agg(F.collect_set(F.length("tail")).alias("tails"), F.max(F.length("tail")).alias("longest"))
    )
    # one entry per length of a head
    lengths = heads.groupBy(F.length("head").alias("h")).agg(F.max("longest").alias("longest"))
    lengths = lengths.agg(F.collect_list(F.struct("h", "longest")).alias("a")).scalar()
    # one blank before and enough behind, so that every window shows its two neighbours
    text = F.concat(F.lit(" "), F.lower("message"), F.repeat(F.lit(" "), F.col("l.longest") + 1))
    places = F.sequence(F.lit(1), F.greatest(F.length("message") - F.col("l.h") + 1, F.lit(1)))
    windows = (
        commits.filter(F.col("message").isNotNull())
        .select("commit", "message", lengths.alias("lengths"))
        .select("commit", "message", F.explode("lengths").alias("l"))
        .select("commit", "l.h", "l.longest", text.alias("text"), F.explode(places).alias("p"))
        .select("commit", "h", F.substring("text", F.col("p"), F.col("h") + F.col("longest") + 3).alias("window"))
        .withColumn("head", F.substring("window", F.lit(2), F.col("h")))
        .join(heads.select("head", "tails"), "head")
        .select("commit", "h", "window", F.explode("tails").alias("t"))
    )
    head = F.substring(F.col("window"), F.lit(2), F.col("h"))
    gap = F.substring(F.col("window"), F.col("h") + 2, F.lit(1))
    tail = F.substring(F.col("window"), F.col("h") + 3, F.col("t"))
    windows = windows.filter(gap != "\n")
    if exact:
        before, after = F.substring("window", 1, 1), F.substring(F.col("window"), F.col("h") + F.col("t") + 3, F.lit(1))
        windows = windows.filter(~before.rlike("[a-z0-9]") & ~after.rlike("[a-z0-9]"))
    candidates = windows.select("commit", head.alias("head"), tail.alias("tail"))
    return candidates.join(keys, ["head", "tail"]).select("commit", "issue_key")


def match_issues(commits: DataFrame, issues: DataFrame, exact: bool = False) -> DataFrame:
    """Bug-fix commits: each commit whose message names at least one issue, once.

    Of several records of a commit the one that names the first issue stays, by ``pos`` of ``issues`` where there is one and else by the key;
    then the first by ``pos`` of ``commits``. Records that agree in all that are told apart by a hash.
    """
    columns = commits.columns
    records = commits.withColumn("_r", F.xxhash64(*columns))
    named = F.struct("commit", "_r").alias("commit")
    hits = issue_hits(records.select(named, "message"), issues, exact)
    if "pos" in issues.columns:
        hits = hits.join(issues.groupBy("issue_key").agg(F.min("pos").alias("_at")), "issue_key")
    else:
        hits = hits.withColumn("_at", F.col("issue_key"))
    first = hits.groupBy(F.col("commit._r").alias("_r")).agg(F.min("_at").alias("_at"))
    order = ["_at", *(["pos"] if "pos" in columns else []), "_r"]
    fixes = records.join(first, "_r").withColumn("_order", F.struct(*order))
    return fixes.groupBy("commit").agg(F.min_by(F.struct(*columns), "_order").alias("c")).select("c.*")


def issue_counts(commits: DataFrame, issues: DataFrame, exact: bool = False) -> DataFrame:
    """``issues_matched`` (issue rows with a match, repeats counted) and ``fix_commits``."""
    hits = store(_named(commits, issues, exact))
    matched = issues.groupBy("issue_key").count().join(hits.select("issue_key").distinct(), "issue_key", "left_semi")
    rows = matched.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("issues_matched"))
    fixes = hits.agg(F.count_distinct("commit").alias("n")).scalar()
    return rows.select("issues_matched", fixes.alias("fix_commits"))


def release_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Commits of ``new`` that ``old`` lacks. A commit repeated inside ``new`` is dropped as well.

    One aggregation: a row of ``new`` counts once and a row of ``old`` twice, and the commits with a
    count of one are the answer, so repeats collapse before the shuffle and no join is needed.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    empty = F.lit(None).cast(new.select(record.alias("r")).schema["r"].dataType)
    tagged = new.select("commit", record.alias("record"), F.lit(1).alias("seen")).unionByName(
        old.select("commit", empty.alias("record"), F.lit(2).alias("seen"))
    )
    once = tagged.groupBy("commit").agg(
        F.sum("seen").alias("seen"), F.any_value("record", True).alias("record")
    )
    return once.filter("seen = 1").select("record.*")


def history_summary(
    v2: DataFrame, v1: DataFrame, v2_fixes: DataFrame, v1_fixes: DataFrame
) -> DataFrame:
    """Commit and bug-fix commit counts of the newer release, the older one and the increment."""
    count = F.count(F.lit(1)).cast("bigint")
    one = v2.agg(count.alias("v2_commits"))
    others = {
        "v1_commits": v1,
        "inc_commits": release_diff(v2.select("commit"), v1.select("commit")),
        "v2_bug_commits": v2_fixes,
        "v1_bug_commits": v1_fixes,
        "inc_bug_commits": release_diff(v2_fixes.select("commit"), v1_fixes.select("commit")),
    }
    return one.select("v2_commits", *[d.agg(count.alias("n")).scalar().alias(k) for k, d in others.items()])


