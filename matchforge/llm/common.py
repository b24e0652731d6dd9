"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.sources.shared import shared_dir, stored  # noqa: F401


def small_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """`df`, its session set to send a thousand rows at a time to Python: texts can be very long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def tidied(f: Callable) -> Callable:
    """A function over a task's batches that gives freed memory back to the system when the task ends; workers live on."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batch, rows: int = 1_000) -> Iterator:
    """A batch or an array a thousand rows at a time: Python copies of long texts stay few."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: What operators remember in a Python worker between tasks, by operator.
_KEPT: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    """Say at the start of a task which operator's memory this worker needs: the others' is given up, so that they don't add up."""
    for other in [k for k in _KEPT if k != name]:
        _KEPT.pop(other)()
    _KEPT[name] = forget
