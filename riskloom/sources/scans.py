"""Scans of the input files, each with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import columns as C

PROJECT_SCHEMA = (
    "project STRING, exp_version STRING, exp_branch STRING, new_version STRING, "
    "new_branch STRING, jira_key STRING, jira_bugs_amount INT"
)
COMMIT_SCHEMA = (
    "commit STRING, commiter STRING, date STRING, message STRING, "
    "paths ARRAY<STRUCT<insertions: STRING, deletions: STRING, path: STRING>>"
)
# The column names of an issue export, in file order.
ISSUE_COLUMNS = [
    "Issue Type", "Issue key", "Issue id", "Summary", "Assignee", "Reporter",
    "Priority", "Status", "Resolution", "Created", "Updated", "Due Date",
]
SMELL_COLUMNS = ["project", "package", "type", "smell", "cause"]


def _file_order():
    """Sortable position of a row in its input: file, split of the file, row in the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project list; columns are set by position, so a byte-order mark in the header is harmless."""
    return spark.read.csv(path, header=True, schema=PROJECT_SCHEMA, enforceSchema=True)


def read_log_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Log text as one row per ``commit-block:`` record, in file order by ``pos``.

    Blocks before the first separator are empty and dropped. A log of several files is
    ordered by file name, then by position in the file.
    """
    raw = spark.read.option("lineSep", "commit-block:").text(path)
    return raw.select(F.col("value").alias("block"), _file_order().alias("pos")).filter(
        F.trim("block") != ""
    )


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Parsed commit log stored as one JSON array of records."""
    return spark.read.schema(COMMIT_SCHEMA).json(path, multiLine=True)


def read_commit_lines(spark: SparkSession, path: str) -> DataFrame:
    """Parsed commit log stored as one JSON record per line (splittable)."""
    return spark.read.schema(COMMIT_SCHEMA).json(path)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issue list; ``issue_key`` and a position that keeps file order."""
    frame = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return frame.select(
        F.col("Issue key").alias("issue_key"),
        _file_order().alias("issue_pos"),
    )


def merge_issue_parts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All part files of an issue export, under the fixed 12 columns."""
    schema = ", ".join(f"`{c}` STRING" for c in ISSUE_COLUMNS)
    return spark.read.csv(
        paths if isinstance(paths, str) else list(paths),
        header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"',
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``path,label`` table."""
    return spark.read.csv(path, schema="path STRING, label INT")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless list of paths; the row number becomes ``file_id`` (from 0)."""
    from riskloom.operators.ordering import running_totals

    listed = spark.read.csv(path, schema="path STRING")
    placed = listed.withColumn("_at", _file_order())
    ranked = running_totals(placed, [F.col("_at")], rank="_n")
    return ranked.select((F.col("_n") - 1).alias("file_id"), "path")


def read_loc(spark: SparkSession, path: str) -> DataFrame:
    """Lines of code per path; rows without a count are dropped."""
    frame = spark.read.csv(path, header=True, schema="Name STRING, CountLineCode BIGINT")
    return frame.select(F.col("Name").alias("path"), F.col("CountLineCode").alias("loc")).dropna()


def read_matrix(spark: SparkSession, path: str, symmetric: bool = True) -> DataFrame:
    """Headerless dense matrix as non-zero cells ``(a, b, w)``; the upper half if symmetric."""
    from riskloom.operators.ordering import running_totals

    lines = spark.read.text(path).withColumn("_at", _file_order())
    rows = running_totals(lines, [F.col("_at")], rank="_n")
    cells = rows.select(
        (F.col("_n") - 1).alias("a"),
        F.posexplode(F.split("value", ",").cast("array<double>")).alias("b", "w"),
    ).select("a", F.col("b").cast("bigint").alias("b"), "w")
    cells = cells.filter(F.col("w") != 0)
    return cells.filter("a < b") if symmetric else cells


def read_token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word-vector text: ``token v1 ... vd`` per line; the ``count dim`` header line is dropped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p"))
    return parts.filter(F.size("p") > 2).select(
        F.element_at("p", 1).alias("token"),
        F.slice("p", F.lit(2), F.size("p") - 1).cast("array<double>").alias("vec"),
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Lexer output, one headerless CSV per source file: ``file, pos, text, token_type``.

    A token file is one row per token; ``pos`` counts from 0 inside each file.
    """
    from riskloom.operators.ordering import rank_within

    frame = spark.read.csv(
        path, schema="text STRING, token_type STRING", multiLine=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).select(
        F.col("_metadata.file_path").alias("file"),
        _file_order().alias("_at"),
        "text",
        "token_type",
    )
    ranked = rank_within(frame, ["file"], [F.col("_at")], rank="_n")
    return ranked.select("file", (F.col("_n") - 1).alias("pos"), "text", "token_type")


def read_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Dependency edges: the first three columns are source, target and count."""
    frame = spark.read.csv(path, header=True)
    src, dst, weight = frame.columns[:3]
    return frame.select(
        F.col(f"`{src}`").alias("src"),
        F.col(f"`{dst}`").alias("dst"),
        F.col(f"`{weight}`").cast("bigint").alias("w"),
    )


def read_smells(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Smell reports, one file per cluster in list order; only the first five columns."""
    tails = ["/".join(p.split("/")[-2:]) for p in paths]
    number = F.create_map(*[x for i, t in enumerate(tails) for x in (F.lit(t), F.lit(i))])
    frame = spark.read.csv(list(paths), header=True, multiLine=True, escape='"')
    tail = F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2), "/")
    return frame.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(frame.columns[:5], SMELL_COLUMNS)],
        number[tail].alias("cluster"),
        _file_order().alias("pos"),
    )


def union_parts(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Parts under one list of columns; a column that a part lacks is NULL there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.select(*columns)


def concat_first_columns(parts: Sequence[DataFrame], n: int = 5) -> DataFrame:
    """The first ``n`` columns of every part, one after the other."""
    whole = parts[0].select(*parts[0].columns[:n])
    for part in parts[1:]:
        whole = whole.union(part.select(*part.columns[:n]))
    return whole


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of earlier runs; a text column ``top_buggy_cluster`` becomes an array."""
    frame = spark.read.csv(path, header=True)
    if "top_buggy_cluster" in frame.columns:
        frame = frame.withColumn("top_buggy_cluster", C.top_list(F.col("top_buggy_cluster")))
    return frame
