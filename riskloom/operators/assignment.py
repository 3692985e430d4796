"""Pairing the groups of two groupings so that most members are in paired groups: an auction in rounds of joins.

Groups of one side bid for groups of the other; prices rise until each bidder has what is best for it at the prices, but for a
small step. Steps shrink from round to round to below what could change the result, whole numbers of members. To let a group
stay alone, each has a stand-in on the other side, and the stand-ins of two groups that overlap may take each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.runtime import attach, discard, new_path, store, store_at

SHRINK = 6  # how much smaller the next step is


def _choices(overlap: DataFrame, scale: int) -> DataFrame:
    """``person, object, benefit``; persons are the groups of a and the stand-ins of b's, objects those of b and the stand-ins of a's."""
    pair = overlap.select(F.col("a_group").cast("string").alias("a"), F.col("b_group").cast("string").alias("b"), "n")
    named = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    zero = F.lit(0).cast("bigint")
    rows = pair.select(F.explode(F.array(
        F.struct(named("real", "a").alias("person"), named("real", "b").alias("object"), (F.col("n") * scale).cast("bigint").alias("benefit")),
        F.struct(named("real", "a").alias("person"), named("stand-in", "a").alias("object"), zero.alias("benefit")),
        F.struct(named("stand-in", "b").alias("person"), named("real", "b").alias("object"), zero.alias("benefit")),
        F.struct(named("stand-in", "b").alias("person"), named("stand-in", "a").alias("object"), zero.alias("benefit")),
    )).alias("e"))
    return rows.select("e.*").groupBy("person", "object").agg(F.max("benefit").alias("benefit"))


def best_pairs(overlap: DataFrame) -> DataFrame:
    """The pairs ``a_group, b_group, n`` (as text) of ``overlap`` with the largest sum of n in which no group is twice.

    Groups that overlap with none are no rows of ``overlap`` and stay alone. Of several best ways one is found. A round stores one row for each group;
    their number depends on the largest n and on how many groups want the same one.
    """
    spark = overlap.sparkSession
    overlap = store(overlap)
    sizes = overlap.agg(F.count_distinct("a_group").alias("a"), F.count_distinct("b_group").alias("b"), F.max("n").alias("n")).first()
    scale = sizes.a + sizes.b + 1
    if not sizes.a:
        return overlap.select(F.col("a_group").cast("string").alias("a_group"), F.col("b_group").cast("string").alias("b_group"), "n")
    choices = store(_choices(overlap, scale))
    persons = store(choices.select("person").distinct())
    none = F.lit(None).cast(choices.schema["person"].dataType)
    path = new_path(spark)
    state = store_at(choices.select("object").distinct().select("object", F.lit(0).cast("bigint").alias("price"), none.alias("owner")), path)
    step = max(1, sizes.n * scale // SHRINK)
    while True:
        while True:
            free = persons.join(state.filter("owner IS NOT NULL").select(F.col("owner").alias("person")), "person", "left_anti")
            offers = choices.join(free, "person").join(state, "object").select("person", "object", "price", (F.col("benefit") - F.col("price")).alias("worth"))
            best = offers.groupBy("person").agg(F.max(F.struct("worth", "object", "price")).alias("o"))
            # one that has a single choice bids a step
            second = offers.join(best, "person").filter(F.col("object") != F.col("o.object")).groupBy("person").agg(F.max("worth").alias("second"))
            gain = F.col("o.worth") - F.coalesce("second", "o.worth") + step
            bids = best.join(second, "person", "left").select("o.object", "person", (F.col("o.price") + gain).alias("bid"))
            won = bids.groupBy("object").agg(F.max_by(F.struct("person", "bid"), F.struct("bid", "person")).alias("won"))
            last, path = path, new_path(spark)
            new = state.join(won, "object", "left").select(
                "object", F.coalesce("won.bid", "price").alias("price"), F.coalesce("won.person", "owner").alias("owner"), F.col("won").isNotNull().alias("moved")
            )
            state = store_at(new, path)
            discard(spark, last)
            moved = not state.filter("moved").isEmpty()
            state = state.drop("moved")
            if not moved:
                break
        if step == 1:
            break
        step = max(1, step // SHRINK)
        last, path = path, new_path(spark)
        state = store_at(state.select("object", "price", none.alias("owner")), path)
        discard(spark, last)
    pairs = state.filter("owner.kind = 'real' AND object.kind = 'real'").select(F.col("owner.name").alias("a_group"), F.col("object.name").alias("b_group"))
    names = overlap.select(F.col("a_group").cast("string").alias("a_group"), F.col("b_group").cast("string").alias("b_group"), "n")
    return pairs.join(names, ["a_group", "b_group"])


def agreement(a: DataFrame, b: DataFrame, overlap: DataFrame, on: str = "path") -> DataFrame:
    """One row: how much of grouping ``a`` (on, grp) has to change to become ``b``, with the best pairing of their groups.

    ``overlap`` is that of ``compare.grouping_overlap``. ``kept`` members are in paired groups. Changes are groups to add or drop, members to move, and two for each member to add or drop (it has to be moved as
    well); ``a2a`` sets them against those of building both from nothing, in percent.
    """
    pairs = best_pairs(overlap).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("kept"), F.count(F.lit(1)).alias("pairs"))
    side = lambda df, x: df.agg(F.count_distinct("grp").alias(f"{x}_groups"), F.count(on).alias(f"{x}_members"))
    shared = overlap.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("shared"))
    row = attach(attach(attach(side(a, "a"), side(b, "b"), "_b"), shared, "_s"), pairs, "_p").select("a_groups", "a_members", "_b.*", "_s.*", "_p.*")
    alone = F.col("a_members") + F.col("b_members") - 2 * F.col("shared")
    row = row.withColumn("changes", F.abs(F.col("a_groups") - F.col("b_groups")) + F.col("shared") - F.col("kept") + 2 * alone)
    whole = F.col("a_groups") + F.col("b_groups") + 2 * (F.col("a_members") + F.col("b_members"))
    return row.withColumn("a2a", F.when(whole > 0, 100 * (1 - F.col("changes") / whole)))
