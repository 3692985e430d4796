"""Comparing methods and groupings: metric tables, effect size, modularity, smells, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators.matching import matching_size
from riskloom.operators.ordering import rank_within, running_totals
from riskloom.runtime import scalar_struct, settle, small_side, store, store_counted

SMELL_KEY = ["cause", "type", "package", "smell"]


def size_split(projects: DataFrame, order_by: Sequence[Column], small: int = 10) -> DataFrame:
    """The first ``small`` projects are ``small``, the others ``large``."""
    placed = running_totals(projects, order_by, rank="position")
    return placed.withColumn("size", F.when(F.col("position") <= small, "small").otherwise("large"))


def metric_gather(data: DataFrame, projects: DataFrame, metric: str) -> DataFrame:
    """One metric of the listed projects, sorted by project."""
    listed = data.join(projects.select("project").distinct(), "project", "left_semi")
    return listed.select("project", metric).orderBy("project")


def metric_pivot(metrics: DataFrame, methods: Sequence[str], scale: float = 1.0, decimals: int | None = 2) -> DataFrame:
    """``project, method, value`` -> one column per method, an ``Average`` row, rounded values."""
    table = metrics.groupBy("project").pivot("method", list(methods)).agg(F.max(F.col("value") * scale))
    table = with_average(table, methods)
    if decimals is None:
        return table
    return table.select("project", *[C.round_even(F.col(f"`{m}`"), decimals).alias(m) for m in methods])


def with_average(table: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Append the row of column means."""
    mean = table.agg(*[F.avg(f"`{m}`").alias(m) for m in methods]).select(F.lit("Average").alias("project"), *methods)
    return table.unionByName(mean)


def cliffs_delta(pairs: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Cliff's delta of two samples per key: (#(a > b) - #(a < b)) / (m n).

    ``pairs`` is long: the key, ``side`` (``a`` or ``b``) and ``value``. Equal values collapse
    first; the samples then meet through running counts in value order, so no value of one
    sample is paired with every value of the other.
    """
    keys = list(keys)
    counts = settle(
        pairs.filter("value IS NOT NULL")
        .groupBy(*keys, "value")
        .agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    )
    totals, n_keys = store_counted(counts.groupBy(*keys).agg(F.sum("na").alias("m"), F.sum("nb").alias("n")))
    placed = settle(
        running_totals(counts, [*[F.col(k) for k in keys], F.col("value")], {"run_a": "na", "run_b": "nb"})
    )
    start = placed.groupBy(*keys).agg(F.min(F.col("run_b") - F.col("nb")).alias("start"))
    # b values below a value, minus b values above it
    placed = placed.join(small_side(store(start), n_keys), keys).join(small_side(totals, n_keys), keys)
    below = F.col("run_b") - F.col("nb") - F.col("start")
    above = F.col("n") - (F.col("run_b") - F.col("start"))
    summed = placed.groupBy(*keys).agg(
        F.sum((F.col("na") * (below - above)).cast("decimal(38,0)")).alias("won"), F.max("m").alias("m"), F.max("n").alias("n")
    )
    return with_magnitude(
        summed.select(
            *keys, C.ratio(F.col("won"), F.col("m").cast("double") * F.col("n").cast("double")).alias("delta")
        )
    )


def with_magnitude(deltas: DataFrame) -> DataFrame:
    """Add the word for the effect size and the short form, e.g. ``0.42(m)``."""
    size = F.abs("delta")
    # The usual thresholds of Cliff's delta.
    word = (
        F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")
    )
    return deltas.withColumn("magnitude", word).withColumn(
        "report", F.concat(C.round_even(F.col("delta"), 2).cast("string"), F.lit("("), F.substring("magnitude", 1, 1), F.lit(")"))
    )


def delta_samples(table: DataFrame, base: str, others: Sequence[str], drop_average: bool = False) -> DataFrame:
    """Long samples of a metric table: the base method against each other one.

    The ``Average`` row takes part like a project unless it is dropped.
    """
    rows = table.filter("project <> 'Average'") if drop_average else table
    sides = [
        F.struct(F.lit(m).alias("method"), F.lit(side).alias("side"), F.col(f"`{c}`").alias("value"))
        for m in others
        for side, c in (("a", base), ("b", m))
    ]
    return rows.select(F.explode(F.array(*sides)).alias("x")).select("x.*")


def cluster_deps(deps: DataFrame, labels: DataFrame) -> DataFrame:
    """Dependencies lifted to clusters, ``(src, dst, w)``; an edge with an unlabelled end is skipped.

    Edges go through the joins as they come and are added up by clusters, so that no task holds a table of file edges.
    """
    ls = labels.select(F.col("path").alias("src"), F.col("label").alias("src_label"))
    ld = labels.select(F.col("path").alias("dst"), F.col("label").alias("dst_label"))
    return (
        deps.select("src", "dst", "w").join(ls, "src")
        .join(ld, "dst")
        .groupBy(F.col("src_label").alias("src"), F.col("dst_label").alias("dst"))
        .agg(F.sum("w").cast("bigint").alias("w"))
    )


def mq_factors(edges: DataFrame) -> DataFrame:
    """Per cluster: intra weight, inter weight and cluster factor ``A / (A + B/2)`` (0 without A)."""
    ends = edges.select("w", F.col("src") == F.col("dst"), F.array_distinct(F.array("src", "dst")).alias("ends")).toDF(
        "w", "inner", "ends"
    )
    per = ends.select("w", "inner", F.explode("ends").alias("label")).groupBy("label").agg(
        F.sum(F.when(F.col("inner"), F.col("w")).otherwise(0)).alias("intra"),
        F.sum(F.when(~F.col("inner"), F.col("w")).otherwise(0)).alias("inter"),
    )
    factor = F.when(F.col("intra") == 0, F.lit(0.0)).otherwise(
        C.ratio(F.col("intra"), F.col("intra") + F.lit(0.5) * F.col("inter").cast("double"))
    )
    return per.withColumn("factor", factor)


def mq(edges: DataFrame) -> DataFrame:
    """Modularity quality: the sum of the cluster factors."""
    return mq_factors(edges).agg(F.sum("factor").alias("mq"))


def first_smells(smells: DataFrame) -> DataFrame:
    """One row per smell, from the first cluster (then row) that lists it."""
    # repeats inside a cluster collapse by hash; the choice of the first cluster sorts what is left
    once = smells.groupBy(*SMELL_KEY, "cluster", "project").agg(F.min("pos").alias("pos"))
    first = once.groupBy(*SMELL_KEY).agg(F.min(F.struct("cluster", "pos", "project")).alias("f"))
    return first.select(*SMELL_KEY, "f.cluster", "f.project")


def smell_jaccard(whole: DataFrame, per_cluster: DataFrame, chosen: DataFrame) -> DataFrame:
    """Shared smells of the whole project and the ``chosen`` clusters over all smells of both.

    Repeats are removed before the clusters are chosen, so a smell of two clusters counts for
    the first one only. Missing keys equal each other.
    """
    left = whole.select(*SMELL_KEY, F.lit(1).alias("l"), F.lit(0).alias("r")).distinct()
    right = (
        first_smells(per_cluster)
        .join(chosen.select("project").distinct(), "project", "left_semi")
        .select(*SMELL_KEY, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    # grouping treats missing keys as equal, which an outer equi-join would not
    sides = left.unionByName(right).groupBy(*SMELL_KEY).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    sums = sides.agg(
        F.sum("l").cast("bigint").alias("in_whole"),
        F.sum("r").cast("bigint").alias("in_chosen"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared"),
        F.count(F.lit(1)).alias("all_smells"),
    )
    return sums.withColumn("jaccard", C.ratio(F.col("shared"), F.col("all_smells")))


def grouping_overlap(a: DataFrame, b: DataFrame, on: str = "path") -> DataFrame:
    """Members shared by each group of ``a`` and each of ``b``: ``(a_group, b_group, n)``."""
    return (
        a.select(on, F.col("grp").alias("a_group"))
        .join(b.select(on, F.col("grp").alias("b_group")), on)
        .groupBy("a_group", "b_group")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mojofm(overlap: DataFrame) -> DataFrame:
    """MoJoFM of grouping ``a`` against the authority ``b``, in percent with one decimal.

    Moves are the members outside the largest overlap of their group; joins are the groups beyond
    the distinct targets. A group with equally large overlaps is free to choose, and the most
    distinct targets are a maximum matching. The largest possible distance is n minus the most
    groups the authority could tell apart, which for group sizes c in ascending order is the
    minimum of (number of groups) and c + groups after it.
    """
    overlap = settle(overlap)
    best = overlap.groupBy("a_group").agg(F.max("n").alias("n"))
    mine = best.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("kept"))
    choices = overlap.join(best, ["a_group", "n"]).select(F.col("a_group").alias("a"), F.col("b_group").alias("b"))
    targets = F.lit(matching_size(choices)).cast("bigint")
    sizes = overlap.groupBy("b_group").agg(F.sum("n").alias("c"))
    histogram = sizes.groupBy("c").agg(F.count(F.lit(1)).alias("with_size"))
    placed = running_totals(histogram, [F.col("c")], {"up_to": "with_size"})
    limits = sizes.agg(F.count(F.lit(1)).alias("l"), F.sum("c").alias("n"))


    apart = placed.withColumn("t", scalar_struct(limits)).agg(
        F.least(F.min("t.l"), F.min(F.col("c") + F.col("t.l") - F.col("up_to"))).alias("apart"), F.min("t.n").alias("n")
    )
    row = apart.withColumn("m", scalar_struct(mine))
    moves = F.col("n") - F.col("m.kept")
    joins = F.col("m.groups") - targets
    return row.select(
        "n", moves.alias("moves"), joins.alias("joins"), (F.col("n") - F.col("apart")).alias("max_distance"),
        C.round_even(100 * (1 - F.coalesce(C.ratio(moves + joins, F.col("n") - F.col("apart")), F.lit(0.0))), 1).alias("mojofm"),
    )


def cluster_layout(files: DataFrame) -> DataFrame:
    """File name of every file in the folder of its cluster: a repeated name gets ``_1``, ``_2``, ...

    ``files`` has ``file_id, path, label``; files are placed in id order, the number goes before the
    extension, and a number is passed over if its name is taken. A name is taken by the first
    file that is itself called so, or by a numbered copy placed before that file; then the file is
    numbered in turn. Names are settled from the plain ones to those with more suffixes, so a
    folder without such clashes needs no round at all.
    """
    named = files.withColumn("name", C.basename(F.col("path")))
    ranked = settle(rank_within(named, ["label", "name"], [F.col("file_id")], rank="_n"))
    groups = ranked.groupBy("label", "name").agg(F.min("file_id").alias("arrival"), F.count(F.lit(1)).alias("n"))
    stem, extension = name_parts(F.col("name"))
    suffix = r"^(.+)_([1-9][0-9]{0,17})$"
    children = groups.select(
        "label",
        F.concat(F.regexp_extract(stem, suffix, 1), extension).alias("parent"),
        F.regexp_extract(stem, suffix, 2).try_cast("bigint").alias("slot"),
        F.col("name").alias("child"),
        "arrival",
    ).filter("slot IS NOT NULL")
    # a numbered name matters if the folder has the plain name as well
    children = settle(children.join(groups.select("label", F.col("name").alias("parent")), ["label", "parent"], "left_semi"))
    nested = children.select("label", F.col("child").alias("name"))
    level = groups.join(nested, ["label", "name"], "left_anti").select("label", "name", F.lit(False).alias("bumped"))
    clashes = not children.isEmpty()
    placed = None
    while True:
        rows = ranked.join(level, ["label", "name"]).withColumn("r", F.col("_n") - F.when(F.col("bumped"), 0).otherwise(1))
        rows = settle(rows) if clashes else rows
        taken = _taken_slots(rows, children.join(level, children.parent == level.name, "left_semi")) if clashes else None
        if taken is not None:
            rows = _shifted(rows, taken.filter("skipped"))
        else:
            rows = rows.withColumn("shift", F.lit(0))
        copy = F.concat(stem, F.lit("_"), (F.col("r") + F.col("shift")).cast("string"), extension)
        done = rows.select("file_id", "path", "label", F.when(F.col("r") == 0, F.col("name")).otherwise(copy).alias("target"))
        placed = done if placed is None else placed.unionByName(done)
        if not clashes:
            return placed
        below = children.join(level.select("label", F.col("name").alias("parent")), ["label", "parent"], "left_semi")
        bumped = below.select("label", F.col("child").alias("name"))
        if taken is not None:
            hit = taken.filter("NOT skipped").select("label", F.col("child").alias("name"), F.lit(True).alias("bumped"))
            bumped = bumped.join(hit, ["label", "name"], "left")
        else:
            bumped = bumped.withColumn("bumped", F.lit(False))
        level = settle(bumped.select("label", "name", F.coalesce("bumped", F.lit(False)).alias("bumped")))
        if level.isEmpty():
            return placed


def _taken_slots(rows: DataFrame, children: DataFrame) -> DataFrame | None:
    """For each numbered name: was it passed over by the copies (``skipped``) or used by one of them?

    ``q`` is the rank of the copy that would have come to the slot. Slots of a name are visited in
    order, one round per slot that its copies can reach, for all names at once.
    """
    copies = rows.filter("r >= 1").select("label", F.col("name").alias("parent"), F.col("r").alias("q"), F.col("file_id").alias("at"))
    counts = copies.groupBy("label", "parent").agg(F.count(F.lit(1)).alias("copies"))
    slots = rank_within(children.join(counts, ["label", "parent"]), ["label", "parent"], [F.col("slot")], rank="j")
    slots = settle(slots.filter(F.col("slot") - F.col("j") < F.col("copies")))
    rounds = slots.agg(F.max("j").alias("j")).first().j
    if rounds is None:
        return None
    visited = None
    for j in range(1, rounds + 1):
        now = slots.filter(F.col("j") == j)
        if visited is None:
            now = now.withColumn("s", F.lit(0))
        else:
            before = visited.groupBy("label", "parent").agg(F.count_if("skipped").alias("s"))
            now = now.join(before, ["label", "parent"])
        now = now.withColumn("q", F.col("slot") - F.col("s")).join(copies, ["label", "parent", "q"], "left")
        now = now.select("label", "parent", "child", "q", (F.col("at").isNull() | (F.col("at") > F.col("arrival"))).alias("skipped"))
        visited = store(now if visited is None else visited.unionByName(now))
    return visited


def _shifted(rows: DataFrame, skips: DataFrame) -> DataFrame:
    """Add ``shift``: how many taken slots a copy passes over, as a running count in rank order."""
    marks = skips.select(
        "label", F.col("parent").alias("name"), F.col("q").alias("r"), F.lit(0).alias("kind"), F.lit(1).alias("inc"),
        F.lit(None).cast("bigint").alias("file_id"), F.lit(None).cast("string").alias("path"),
    )
    both = rows.select("label", "name", "r", F.lit(1).alias("kind"), F.lit(0).alias("inc"), "file_id", "path").unionByName(marks)
    running = settle(running_totals(both, [F.col(c) for c in ("label", "name", "r", "kind", "file_id")], {"total": "inc"}, rank="_at"))
    start = running.groupBy("label", "name").agg(F.min(F.col("total") - F.col("inc")).alias("start"))
    return running.filter("kind = 1").join(start, ["label", "name"]).withColumn("shift", F.col("total") - F.col("start"))


def name_parts(name: Column) -> tuple[Column, Column]:
    """Stem and extension (with its dot, empty without one); leading dots belong to the stem."""
    extension = F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension)), extension
