"""Min-max scaling, entropy weights and weighted sums over a decision matrix.

A decision matrix has one row per alternative and one numeric column per criterion. Bounds and
weights are single rows, read back as scalar subqueries, so no step needs a global window.
Callers that use a matrix for several of the steps settle it first. With ``by`` every step treats each
group of rows, for instance each project, as a matrix of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.runtime import attach

# The range that criteria are scaled to.
LOW, HIGH = 0.002, 0.996


def minmax_scale(
    df: DataFrame, directions: Mapping[str, str], lo: float = LOW, hi: float = HIGH, by: Sequence[str] = ()
) -> DataFrame:
    """Scale each criterion to [lo, hi]; ``pos`` keeps the order and ``neg`` reverses it.

    A constant criterion has no range: it becomes NULL and later weighs nothing.
    """
    bounds = df.groupBy(*by).agg(
        *[f(c).alias(f"{n}_{c}") for c in directions for f, n in ((F.min, "min"), (F.max, "max"))]
    )
    framed = attach(df, bounds, "_bounds", by)
    scaled = {}
    for c, direction in directions.items():
        low, high = F.col(f"_bounds.min_{c}"), F.col(f"_bounds.max_{c}")
        distance = F.col(c) - low if direction == "pos" else high - F.col(c)
        scaled[c] = (hi - lo) * C.ratio(distance, high - low) + lo
    return framed.withColumns(scaled).drop("_bounds")


def entropy_weights_row(df: DataFrame, criteria: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Entropy weights as one row (per group) with a column per criterion.

    With p = x/S the entropy is -(sum(x ln x)/S - ln S)/ln n, so one pass of sums is enough.
    A single alternative carries no information and gets equal weights.
    """
    x_ln_x = {c: F.when(F.col(c) > 0, F.col(c) * F.ln(c)).otherwise(F.lit(0.0)) for c in criteria}
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in criteria],
        *[F.sum(x_ln_x[c]).alias(f"_l_{c}") for c in criteria],
    )
    entropy = {
        c: -F.try_divide(
            F.try_divide(F.col(f"_l_{c}"), F.col(f"_s_{c}")) - F.ln(f"_s_{c}"), F.ln("_n")
        )
        for c in criteria
    }
    diverse = sums.select(*by, "_n", *[F.coalesce(1 - entropy[c], F.lit(0.0)).alias(c) for c in criteria])
    total = sum((F.col(c) for c in criteria), F.lit(0.0))
    return diverse.select(
        *by,
        *[
            F.when(F.col("_n") <= 1, F.lit(1.0 / len(criteria)))
            .otherwise(C.ratio(F.col(c), total))
            .alias(c)
            for c in criteria
        ]
    )


def entropy_weights(df: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """Entropy weights as ``(criterion, weight)``."""
    row = entropy_weights_row(df, criteria)
    return row.unpivot([], list(criteria), "criterion", "weight")


def weighted_sum(
    df: DataFrame,
    criteria: Sequence[str],
    weights: DataFrame,
    negated: Sequence[str] = (),
    score: str = "score",
    by: Sequence[str] = (),
) -> DataFrame:
    """Add the weighted sum of the criteria; those in ``negated`` count with a minus sign."""
    framed = attach(df, weights.select(*by, *criteria), "_w", by)
    total = F.lit(0.0)
    for c in criteria:
        term = F.coalesce(F.col(c) * F.col(f"_w.{c}"), F.lit(0.0))
        total = total - term if c in negated else total + term
    return framed.withColumn(score, total).drop("_w")


def best_k(scored: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """The k with the highest score; the smallest one wins a tie. With ``by``, that of each group."""
    if not by:
        return scored.orderBy(F.col(score).desc(), "k").limit(1).select("k", score)
    order = F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col("k"))
    return scored.groupBy(*by).agg(F.max_by(F.struct("k", score), order).alias("_b")).select(*by, "_b.k", f"_b.{score}")
