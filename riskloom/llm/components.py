"""Connected components of an edge table, by alternating star rounds."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.runtime import discard, shared_folder

ROWS_PER_PART = 20_000


def sized(df: DataFrame, rows: int, per_part: int = ROWS_PER_PART) -> DataFrame:
    """Merge the partitions of a table of about ``rows`` rows, so that small tables do not make many tiny tasks.

    A table with more rows than its partitions times ``per_part`` stays as it is.
    """
    return df.coalesce(max(1, math.ceil(rows / per_part)))


def store_marked(df: DataFrame, made: list[str] | None = None) -> tuple[DataFrame, int, tuple]:
    """Write ``df`` to the shared folder; the stored table, its rows, and a mark of its content taken while writing.

    Its path is added to ``made``.
    """
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if made is not None:
        made.append(path)
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"], (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``: component is the smallest node reachable.

    Rounds of large stars (every larger neighbour is linked to a node's smallest neighbour) and small
    stars (the node and its smaller neighbours are linked to the smallest of them) until nothing
    changes. The edge table never grows beyond its first size plus the nodes, no neighbour list is
    gathered, and the minima are stored before they are joined back, so that both sides of each join are
    plain shuffles whose hot keys Spark can split. NULL ends and loops are ignored; an empty
    table gives an empty result.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    made: list[str] = []
    links, n, before = store_marked(links, made)
    while n:
        links, n, now = _small_star(_large_star(links, n, made), n, made)
        for path in made[:-1]:  # those that led to the newest
            discard(edges.sparkSession, path)
        made = made[-1:]
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _large_star(links: DataFrame, n: int, made: list[str]) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = store_marked(sized(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n), made)[0]
    moved = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return store_marked(sized(moved.distinct(), n), made)[0]


def _small_star(links: DataFrame, n: int, made: list[str]) -> tuple[DataFrame, int, tuple]:
    lowest = store_marked(sized(links.groupBy("u").agg(F.min("v").alias("m")), n), made)[0]
    moved = links.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return store_marked(sized(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), n), made)
