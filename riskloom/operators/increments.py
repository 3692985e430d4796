"""A co-change matrix kept up to date: stored as signed parts, one for each increment, that add up to the matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.cochange import cochange, commit_pairs
from riskloom.runtime import discard, new_path, store

SCHEMA = "a bigint, b bigint, w bigint"


def changes_between(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Touches (distinct ``commit, file_id``) that an increment adds to ``old`` and drops from it, to get to ``new``.

    A commit whose files differ is dropped and added as a whole, since its pairs change.
    """
    side = lambda df, name: df.groupBy("commit").agg(
        F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file_id")), F.sum(F.hash("file_id"))).alias(name)
    )
    both = side(old, "o").join(side(new, "n"), "commit", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")))
    differ = store(both.select("commit"))
    return new.join(differ, "commit", "left_semi"), old.join(differ, "commit", "left_semi")


def delta(added: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """What an increment adds to the matrix, ``a, b, w``; w is negative where more is dropped. Work follows the increment and not the history."""
    if dropped is None:
        return cochange(added)
    signed = lambda touched, w: commit_pairs(touched).withColumn("w", F.lit(w).cast("bigint"))
    return summed(signed(added, 1).unionByName(signed(dropped, -1)))


def summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a", "b").agg(F.sum("w").cast("bigint").alias("w")).filter("w <> 0")


def put(edges: DataFrame, path: str, part: int) -> None:
    """Write one part. A part that is written again takes the place of itself, so that a repeated increment counts once."""
    edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("w").cast("bigint").alias("w")).write.mode("overwrite").parquet(
        f"{path}/part={part}"
    )


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """The matrix ``a, b, w`` from all parts."""
    return summed(spark.read.schema(f"{SCHEMA}, part bigint").parquet(path).drop("part"))


def compact(spark: SparkSession, path: str) -> str:
    """The matrix as a single part under a new path, for many small parts; the old one is left to its owner."""
    fresh = new_path(spark)
    put(matrix(spark, path), fresh, 0)
    return fresh


def drop(spark: SparkSession, path: str) -> None:
    discard(spark, path)
