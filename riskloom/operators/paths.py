"""Resolving log paths to files of the release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A log path is covered by its first and its last 2^e characters, the longest that fit.
ANCHORS = [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]


def path_matches(log_paths: DataFrame, files: DataFrame) -> DataFrame:
    """All ``(log_path, file_id)`` where the log path is a literal part of the file's path.

    Files are expanded to their windows of the anchor lengths in use. A window that ends like a log
    path is kept with the lengths of the log paths that end so, which fixes where such a path
    would start; the second join then asks for the same start. Start and end cover the whole
    path up to 1024 characters, so copies of one tree do not meet each other, and only longer
    paths need the comparison at the end.
    """
    wanted = log_paths.select("log_path").filter(F.length("log_path") > 0).distinct()
    size = F.lit(ANCHORS[-1])
    for n in reversed(ANCHORS[:-1]):
        size = F.when(F.length("log_path") >= n, n).otherwise(size)
    wanted = wanted.select("log_path", size.alias("_size"), F.length("log_path").alias("_len")).select(
        "*",
        F.substring(F.col("log_path"), F.lit(1), F.col("_size")).alias("_head"),
        F.substring(F.col("log_path"), F.col("_len") - F.col("_size") + 1, F.col("_size")).alias("_tail"),
    )
    sizes = wanted.agg(F.collect_set("_size").alias("s")).scalar()  # at most len(ANCHORS) values
    lengths = wanted.groupBy("_size", "_tail").agg(F.collect_set("_len").alias("_lens"))  # no more than a path is long
    windows = F.transform(
        F.sequence(F.lit(1), F.length("path") - F.col("_size") + 1),
        lambda i: F.struct(i.alias("at"), F.substring(F.col("path"), i, F.col("_size")).alias("tail")),
    )
    ended = (
        files.select("file_id", "path", sizes.alias("_sizes"))
        .select("file_id", "path", F.explode("_sizes").alias("_size"))
        .filter(F.length("path") >= F.col("_size"))
        .select("file_id", "path", "_size", F.explode(windows).alias("w"))
        .select("file_id", "path", "_size", F.col("w.at").alias("_at"), F.col("w.tail").alias("_tail"))
        .join(lengths, ["_size", "_tail"])
        .select("file_id", "path", "_size", "_tail", "_at", F.explode("_lens").alias("_len"))
    )
    start = F.col("_at") + F.col("_size") - F.col("_len")
    begun = ended.filter(start >= 1).select(
        "file_id", "_size", "_tail", "_len", F.substring(F.col("path"), start, F.col("_size")).alias("_head"),
        F.substring(F.col("path"), start, F.col("_len")).alias("_found"),
    )
    return (
        begun.join(wanted, ["_size", "_tail", "_len", "_head"])
        .filter(F.col("_found") == F.col("log_path"))
        .select("log_path", "file_id")
        .distinct()
    )


def resolve_paths(log_paths: DataFrame, files: DataFrame) -> DataFrame:
    """First file (by ``file_id``) whose path contains the log path, with the number of candidates."""
    return path_matches(log_paths, files).groupBy("log_path").agg(
        F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("candidates")
    )


def ambiguous_paths(log_paths: DataFrame, files: DataFrame) -> DataFrame:
    """Log paths that more than one file contains."""
    return resolve_paths(log_paths, files).filter("candidates > 1")


def resolve_changes(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Attach ``file_id`` to changed-file rows; rows that match no file are dropped."""
    found = resolve_paths(changes.select(F.col("path").alias("log_path")), files)
    return changes.join(
        found.select(F.col("log_path").alias("path"), "file_id"), "path"
    )
