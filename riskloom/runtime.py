"""Cluster concerns shared by the operators: stage boundaries and checked broadcasts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hint only if a count taken beforehand, times the width of its columns, is at most this.
BROADCAST_BYTES = 16_000_000
NAME_BYTES = 256

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stored tables, which every executor can reach.

    It is the one of ``spark.checkpoint.dir``. Where that is unset, a folder below the warehouse
    is set, by Hadoop's path rules and thus in the store the warehouse is in. On a cluster whose warehouse is a folder of
    one machine, that would not be shared, so it raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(configured or below_warehouse(sc.master, spark.conf.get("spark.sql.warehouse.dir")))
    return sc.getCheckpointDir()


def below_warehouse(master: str, warehouse: str) -> str:
    """The folder to use where none is set."""
    local_store = warehouse.startswith(("file:", "/")) or ":" not in warehouse
    if local_store and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is on one machine")
    return f"{warehouse}/_checkpoints"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    Used where a table is read by several later branches or by an iteration, so
    that a lost executor restarts from the shared folder and no branch repeats the
    work upstream.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    For iterations: unlike a checkpoint the scan carries no constraints from the plan it came
    from, which would otherwise pile up round after round in the optimizer.
    """
    return store_at(df, new_path(df.sparkSession))


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def store_at(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write to a path from ``new_path``, to be able to add to the table or to discard it."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def store_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``store`` with the number of rows, taken while writing."""
    seen = Observation()
    stored = store(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return stored, seen.get["n"]


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` of numbers or short names are few; otherwise leave a shuffle join.

    Columns count by their width, names as ``NAME_BYTES``; a table with nested columns is never hinted.
    """
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8}
    kinds = [kind for _, kind in df.dtypes]
    if any(kind not in widths and kind != "string" for kind in kinds):
        return df
    return F.broadcast(df) if rows * sum(widths.get(kind, NAME_BYTES) for kind in kinds) <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """Keep ``df`` from being broadcast in its next join, for a side whose bytes on disk tell nothing of its rows.

    Spark takes a scan for as small as its compressed file, and what is exploded from it as well.
    """
    return df.hint("merge")


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan of few splits over all cores, for steps that work hard on each row.

    A scan that already has a split per core stays as it is. Meant for scans: asking a plan with
    shuffles for its partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def attach(df: DataFrame, values: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``values`` as a struct ``name``: its single row, or its row for each group of ``by``."""
    if not by:
        return df.withColumn(name, scalar_struct(values))
    rest = [F.col(f"`{c}`") for c in values.columns if c not in by]
    return df.join(store(values.select(*by, F.struct(*rest).alias(name))), list(by), "left")


def scalar_struct(df: DataFrame):
    """The single row of ``df`` as a struct-valued scalar subquery column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).scalar()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path, wherever the driver was started.

    On a cluster whose machines do not share that path the package has to be shipped (``--py-files``).
    """
    known = df.sparkSession.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return df.mapInArrow(fn, schema)
