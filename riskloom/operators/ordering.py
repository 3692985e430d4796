"""Global ranks and running sums without sending all rows through one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.runtime import settle

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    totals: Mapping[str, str] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Number the rows of ``df`` from 1 in ``order_by`` order and add inclusive running sums.

    ``totals`` maps a new column to the column it accumulates. The rows are range
    partitioned once and settled; each partition then works alone, and only one row per
    partition (its count and sums) is needed to place it after its predecessors.
    """
    totals = dict(totals or {})
    laid = settle(df.orderBy(*order_by)).withColumn("_at", F.monotonically_increasing_id())
    laid = laid.withColumn("_part", F.shiftright("_at", _ROW_BITS))

    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = laid.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(src).alias(f"_s_{new}") for new, src in totals.items()],
    )
    # one row per partition: its size is set by the cluster, not by the data
    offsets = offsets.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in totals],
    )
    within = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    placed = laid
    for new, src in totals.items():
        placed = placed.withColumn(f"_l_{new}", F.coalesce(F.sum(src).over(within), F.lit(0)))
    return placed.join(F.broadcast(offsets), "_part").select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_n0") + F.col("_at") - F.shiftleft("_part", _ROW_BITS) + 1).alias(rank),
        *[(F.col(f"_o_{new}") + F.col(f"_l_{new}")).alias(new) for new in totals],
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """Number rows from 1 inside each key group; a huge group is spread like any other rows."""
    ranked = settle(
        running_totals(df, [F.col(k) for k in keys] + list(order_by), rank="_global")
    )
    start = ranked.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_global").alias("_start"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return ranked.join(start, condition).select(
        *df.columns, (F.col("_global") - F.col("_start") + 1).alias(rank)
    )
