"""Sinks: tables, JSON records, appended result rows, dense matrices, RSF and per-cluster layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, header=header, mode="overwrite")


def write_records(df: DataFrame, path: str) -> None:
    """One JSON record per line."""
    df.write.json(path, mode="overwrite")


def append_result(df: DataFrame, path: str) -> None:
    """Add result rows to a stored table, creating it on first use. A rerun adds its rows again."""
    flat = df.select(
        *[F.to_json(c).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    )
    flat.write.csv(path, header=True, mode="append")


def add_columns(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add whole columns to a stored table, replacing those of the same name."""
    return df.withColumns(values)


def densify(edges: DataFrame, ids: DataFrame, id_col: str = "file_id", weight: str = "w") -> DataFrame:
    """Dense rows ``(id, row_values)`` of a sparse symmetric matrix, zeros filled in.

    A dense row has one value per id by definition. It is filled from its own non-zero
    cells only, against the sorted id list, so no id x id grid of rows is built.
    """
    both = edges.select(F.col("a").alias("id"), F.struct(F.col("b").alias("col"), F.col(weight).alias("v")).alias("cell")).unionByName(
        edges.select(F.col("b").alias("id"), F.struct(F.col("a").alias("col"), F.col(weight).alias("v")).alias("cell"))
    )
    cells = both.groupBy("id").agg(F.map_from_entries(F.collect_list("cell")).alias("cells"))
    columns = ids.agg(F.array_sort(F.collect_set(id_col)).alias("c")).scalar()
    keyed = ids.select(F.col(id_col).alias("id")).join(cells, "id", "left")
    zero = F.lit(0).cast(dict(edges.dtypes)[weight])
    filled = F.transform(
        F.col("_columns"), lambda c: F.coalesce(F.try_element_at(F.col("cells"), c), zero)
    )
    return keyed.withColumn("_columns", columns).select(
        "id", F.when(F.col("cells").isNull(), F.transform("_columns", lambda c: zero)).otherwise(filled).alias("row_values")
    )


def write_matrix(edges: DataFrame, ids: DataFrame, path: str, id_col: str = "file_id", weight: str = "w") -> None:
    """Headerless dense matrix, rows in id order."""
    rows = densify(edges, ids, id_col, weight).orderBy("id")
    rows.select(F.array_join(F.col("row_values").cast("array<string>"), ",").alias("line")).write.text(path)


def rsf_rows(df: DataFrame, group: Column, member: Column) -> DataFrame:
    return df.select(F.lit("contain").alias("relation"), group.cast("string").alias("grp"), member.alias("member"))


def write_rsf(rows: DataFrame, path: str) -> None:
    """Space separated ``contain group member`` lines without a header."""
    rows.write.csv(path, sep=" ", header=False, mode="overwrite", quote="")


def write_cluster_folders(laid_out: DataFrame, path: str) -> None:
    """Write rows under one folder per label, e.g. the result of ``cluster_layout``."""
    laid_out.write.partitionBy("label").mode("overwrite").parquet(path)


def matrix_cells(dense: DataFrame) -> DataFrame:
    """Dense rows back to ``(id, pos, value)`` cells."""
    return dense.select("id", F.posexplode("row_values").alias("pos", "value"))

