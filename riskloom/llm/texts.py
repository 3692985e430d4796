"""Reading texts inside tasks: Arrow batches cut into slices of bounded size."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Bytes of text that are held as arrays at a time; a single longer text makes a slice of its own.
SLICE_BYTES = 2_000_000

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path, wherever the driver was started.

    On a cluster whose machines do not share that path the package has to be shipped (``--py-files``).
    """
    known = df.sparkSession.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` whose ``column``, of texts or of lists, holds about ``limit`` bytes or elements each."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    sizes = pc.fill_null(length(values), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def per_slice(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Map slices of ``df`` to record batches of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)

    return map_batches(df, run, schema)


def fields(df: DataFrame, names: list[str], own: str) -> str:
    """Schema text of an operator's ``own`` columns and those of its input that it hands on; see ``unclashing``."""
    unclashing(names, [f.split()[0] for f in own.split(", ")])
    return own + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def unclashing(names: list[str], own: list[str]) -> None:
    """Raise if a column to hand on has the name of an operator's own, or is named twice: the result could not tell them apart."""
    clash = sorted({c for c in names if c.lower() in {o.lower() for o in own} or names.count(c) > 1})
    if clash:
        raise ValueError(f"columns {clash} cannot be handed on beside {own}; rename them first")


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as bytes; NULL as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
