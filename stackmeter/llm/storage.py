"""Tables between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import storage as _base
from ..storage import drop, fields_of, new_path, release, shared_dir

__all__ = ["alone", "drop", "fields_of", "lean", "materialise", "new_path", "release", "shared_dir", "text_batches"]

#: Rows that go to a Python worker at a time: four times ten thousand texts, in Spark and in Python, fill an executor.
ROWS, _ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


class _Made(threading.local):
    """Paths of the tables that the operators running in this thread have made, the innermost operator's last."""

    def __init__(self) -> None:
        self.paths: list[list[str]] = []


_MADE = _Made()


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    path = path or new_path(df.sparkSession, name)
    if _MADE.paths:
        _MADE.paths[-1].append(path)
    return _base.materialise(df, name, path)


def alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a table, without the tables that were made on the way."""
    path = new_path(spark, name)
    _MADE.paths.append([])
    try:
        out = _base.materialise(make(), name, path)
    finally:
        for p in _MADE.paths.pop():
            drop(spark, p)
    if _MADE.paths:
        _MADE.paths[-1].append(path)
    return out


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, its session sending at most ``ROWS`` rows at a time to Python.

    Rows here are whole texts; Spark plans the batches when a result is written, after the operator has returned, so
    this is a setting of the session and stays.  A lower one is left alone.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= ROWS:
        conf.set(_ROWS, str(ROWS))
    return df


def _trim() -> None:
    """Give freed memory back to the system; where the C library has no such call it stays with the process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition, after which its Python worker, which Spark keeps for later tasks, holds no freed memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped
