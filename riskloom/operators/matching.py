"""Maximum matching of a bipartite edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.runtime import store


def matching_size(edges: DataFrame) -> int:
    """Most edges ``(a, b)`` that can be chosen with no ``a`` and no ``b`` twice.

    Starts from the pairs that each ``b`` keeps of the first choices. A phase then searches from
    all free ``a`` at once along alternating edges; every ``b`` joins the tree that reaches it
    first, so the trees share nothing and all paths that end in a free ``b`` are flipped together.
    """
    edges = store(edges.select("a", "b").distinct())
    first = edges.groupBy("a").agg(F.min("b").alias("b"))
    match = store(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    while True:
        better = _augmented(edges, match)
        if better is None:
            return match.count()
        match = better


def _augmented(edges: DataFrame, match: DataFrame) -> DataFrame | None:
    """The matching with more edges that one phase finds, or None if it is the largest."""
    partner = match.select(F.col("a").alias("next"), "b")
    frontier = edges.select("a").distinct().join(match, "a", "left_anti").withColumn("root", F.col("a"))
    visited, ends, depth = None, None, 0
    while ends is None:
        step = frontier.join(edges, "a")
        if visited is not None:
            step = step.join(visited.select("b"), "b", "left_anti")
        step = step.groupBy("b").agg(F.min(F.struct("a", "root")).alias("via"))
        step = store(step.select("b", "via.a", "via.root").join(partner, "b", "left"))
        if step.isEmpty():
            return None
        depth += 1
        visited = step if visited is None else visited.unionByName(step)
        if not step.filter("next IS NULL").isEmpty():
            ends = step.filter("next IS NULL").groupBy("root").agg(F.min("b").alias("b"))
        frontier = step.filter("next IS NOT NULL").select(F.col("next").alias("a"), "root")
    # walk back: b is matched with the node it was reached from, whose old partner comes next
    flipped, at = None, store(ends.select("b"))
    for _ in range(depth):
        pairs = store(at.join(visited, "b").select("a", "b"))
        flipped = pairs if flipped is None else flipped.unionByName(pairs)
        at = pairs.select("a").join(match, "a").select("b")
    return store(match.join(flipped.select("a"), "a", "left_anti").unionByName(flipped))
