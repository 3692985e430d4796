"""A growing folder of log files followed as a stream, each micro-batch counted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators import cochange, history, increments, paths


def log_blocks(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """New files of ``folder`` as a stream of ``commit-block:`` records, ``block, pos``; files have to be complete when they appear."""
    reader = spark.readStream.option("lineSep", "commit-block:")
    if files_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.text(folder).filter(F.trim("value") != "").select(F.col("value").alias("block"), F.lit(0).cast("bigint").alias("pos"))


def follow(blocks: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give the parsed commits of each micro-batch and its number to ``each`` until the files at hand are done.

    After a failure the last batch comes again under the same number.
    """

    def run(batch: DataFrame, number: int) -> None:
        each(history.parse_blocks(batch), number)

    return blocks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_cochange(spark: SparkSession, folder: str, files: DataFrame, stored: str, checkpoint: str, files_at_once: int | None = None) -> DataFrame:
    """The co-change matrix of all logs in ``folder`` so far, from the stored parts and the files that are new since the last call.

    ``files`` has ``file_id, path``. A batch becomes the part of its number, written anew if it comes again. A commit has to be in one file only.
    """

    def add(commits: DataFrame, number: int) -> None:
        resolved = paths.resolve_changes(history.changed_files(commits, "strict"), files)
        increments.put(increments.delta(cochange.touches(resolved)), stored, number)

    follow(log_blocks(spark, folder, files_at_once), checkpoint, add).awaitTermination()
    return increments.matrix(spark, stored)
