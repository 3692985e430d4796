"""Which files change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.runtime import BROADCAST_BYTES, shuffled, small_side, store, store_counted

CHUNK = 512


def touches(changes: DataFrame) -> DataFrame:
    """Distinct ``(commit, file_id)``; rows without one of them are no touch.

    The filter is spelled out so that every branch that reads the result keeps the same plan up to
    its shuffle, and the shuffle is run once and reused.
    """
    both = F.col("commit").isNotNull() & F.col("file_id").isNotNull()
    return changes.select("commit", "file_id").filter(both).distinct()


def cochange(touched: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Sparse co-change matrix ``(a, b, w)`` with ``a < b``: commits that touch both files. ``touched`` is distinct."""
    return commit_pairs(touched, chunk).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def commit_pairs(touched: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pairs ``(a, b)`` with ``a < b`` of the files of each commit, once for each commit that touches both.

    The rows of the answer are pairs, so pairs have to be formed. The files of a commit are put into
    one array; a commit of more than ``chunk`` is cut by a hash of the file into several of about that many, which meet
    each other in a join. The largest unit of work is then ``chunk`` x ``chunk`` whatever the commit, nothing but the arrays is
    sorted or joined. Pairs are not shuffled here, so that repeated ones can collapse before the shuffle of their counts.
    """
    touched = touched.filter("commit IS NOT NULL")
    large, n = store_counted(touched.groupBy("commit").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > chunk))
    # a hint only where the large commits are few; otherwise their sizes are not broadcast
    chosen = small_side(large, n) if n * 16 <= BROADCAST_BYTES else shuffled(large)
    placed = touched.join(chosen, "commit", "left").withColumn("_n", F.coalesce(F.ceil(F.col("_m") / chunk), F.lit(1)).cast("int"))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("file_id"), "_n").cast("int"))
    arrays = placed.groupBy("commit", "_n", "_own").agg(F.sort_array(F.collect_list("file_id")).alias("files"))
    if n:
        arrays = store(arrays)
    each = arrays.filter(F.size("files") > 1).select("files", F.posexplode("files").alias("_at", "a"))
    pairs = each.select("a", F.explode(F.slice("files", F.col("_at") + 2, F.size("files"))).alias("b")).filter("a < b")
    if n:
        celled = arrays.filter("_n > 1").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).filter("_own <> _other")
        celled = celled.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        # the left array is chunk _i and the right one chunk _j of the same cell
        left = celled.filter("_own = _i").select("commit", "_i", "_j", F.col("files").alias("xs"))
        right = celled.filter("_own = _j").select("commit", "_i", "_j", F.col("files").alias("ys"))
        met = left.join(right, ["commit", "_i", "_j"]).select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
        pairs = pairs.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return pairs


def mirror(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("a", "b", "w").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    )


def cochange_degree(touched: DataFrame) -> DataFrame:
    """Row sums of the co-change matrix, ``(file_id, degree)``, without forming its pairs.

    A file gains the number of other files of every commit that touches it. The sizes of all commits are not broadcast.
    """
    sizes = store(touched.groupBy("commit").agg((F.count(F.lit(1)) - 1).alias("_others")).filter("_others > 0"))
    return (
        touched.join(shuffled(sizes), "commit").groupBy("file_id").agg(F.sum("_others").alias("degree"))
    )


def degree_of_edges(edges: DataFrame) -> DataFrame:
    """Row sums of a stored co-change matrix."""
    return mirror(edges).groupBy(F.col("a").alias("file_id")).agg(F.sum("w").cast("bigint").alias("degree"))
