"""Helpers to run Arrow functions over DataFrames."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch; small, as single texts may be long.
BATCH_ROWS = 1000

#: What workers remember from task to task, by name: how to forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def _forget_others(keeps: str | None) -> None:
    """In a worker: forget what is remembered under other names. A function of the module, so that the worker's own memory is meant."""
    for name, forget in REMEMBERED.items():
        if name != keeps:
            forget()


def _give_back() -> None:
    """Return what a finished task has freed to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], schema: T.StructType, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` where ``fn`` also gets the Arrow schema of its result.

    ``keeps`` names what its tasks remember for each other; what a worker remembers from others is forgotten first.
    """
    arrow = to_arrow_schema(schema)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_others(keeps)
        try:
            yield from fn(batches, arrow)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def plus(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """The schema with fields added; a field of the same name (in any case) gives way."""
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(fields))
