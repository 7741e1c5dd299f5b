"""Intermediate tables on storage that all executors share, and filters of ids of bounded size."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscope.functions.sizing import materialise, shared_folder

__all__ = ["filter_bit", "id_filter", "lean", "materialise", "only", "passes", "per_worker", "shared_folder", "small_batches", "written"]

# A filter of ids has so many bits (512 KiB), whatever the number of ids: it may pass too many, never too few.
FILTER_BITS = 1 << 22
_BLOCK = 32768
# Arrow batches to workers have about so many bytes, where Spark's own bound is 10,000 rows and 64 MB.
BATCH_BYTES = 1 << 22
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The columns an operator works on, under its own names, so that no others can clash with them."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the shared folder, read again: narrower than a checkpoint, and read a column at a time."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def filter_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit map of the hashed values of ``column``: at most 128 blocks of 4 KiB come to the driver."""
    rows = (
        ids.where(F.col(column).isNotNull()).select((filter_bit(column) + 1).alias("bit"))
        .groupBy(F.expr("bitmap_bucket_number(bit)").alias("block"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()
    )
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["block"] - 1) * _BLOCK // 8
        held[at:at + _BLOCK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return held


def passes(held: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the bits are set: inside a task, for the rows' ``filter_bit``."""
    return (held[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


_STATE = "columnscope_worker_state"


def per_worker(kind: str, key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a worker process and kept for its later tasks; a new key of a kind replaces the old.

    Functions travel to workers by value, so their module's globals are new in every task; a module of the process is not.
    """
    state = sys.modules.setdefault(_STATE, types.ModuleType(_STATE)).__dict__
    if kind not in state or state[kind][0] != key:
        state[kind] = (key, make())
    return state[kind][1]


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task whose worker process first drops what other operators keep in it, and hands back unused memory before and after.

    Workers live as long as the session, and the allocators keep what a task has freed, so an executor would hold the largest
    of all steps' memory in each of its workers.
    """
    sys.modules.pop(_STATE, None)
    _hand_back()
    yield from batches
    _hand_back()


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:  # glibc alone has it
        trim(0)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile send rows to Python workers ``BATCH_BYTES`` at a time (one longer row alone); a bound that the session sets stays."""
    if spark.conf.get(_BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_CONF)
