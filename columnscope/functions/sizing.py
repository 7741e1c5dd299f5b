"""Physical decisions: how big is an input, how many buckets, where to cut lineage."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from columnscope.errors import ValidationError

# Inputs up to this size may keep the distinct values of one group in one task (Spark's own percentile).
EXACT_IN_MEMORY_CONF = "spark.columnscope.exactInMemoryBytes"
EXACT_IN_MEMORY_DEFAULT = 128 * 1024 * 1024

# Rows that one task of a large derived table holds.
ROWS_PER_TASK = 500_000
BYTES_PER_BUCKET = 64 * 1024 * 1024
MIN_BUCKETS = 8
MAX_BUCKETS = 16_384


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimised plan, None where no classic session is behind it."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except AttributeError:
        return None


def fits_in_memory(df: DataFrame) -> bool:
    limit = int(df.sparkSession.conf.get(EXACT_IN_MEMORY_CONF, str(EXACT_IN_MEMORY_DEFAULT)))
    size = estimated_bytes(df)
    return size is not None and size <= limit


def bucket_target(df: DataFrame) -> int:
    """How many equal-count value ranges to cut a column into; bounded, and grows with the input."""
    size = estimated_bytes(df)
    if size is None:
        return MAX_BUCKETS
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(MIN_BUCKETS, min(MAX_BUCKETS, max(cores, math.ceil(size / BYTES_PER_BUCKET))))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``, or in local mode a temporary one where none is set.

    Executors of a cluster cannot read a folder of the driver's machine, so a cluster has to name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValidationError("Set spark.checkpoint.dir to a folder that all executors share.")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="columnscope-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shared_scan(df: DataFrame) -> Iterator[DataFrame]:
    """Input of an operator that reads its table several times and finishes its jobs before it returns.

    A small table is spread over all cores and kept in memory meanwhile (small files often arrive as one
    split); a large one is scanned again each time, with only the columns each pass needs.
    """
    if not fits_in_memory(df) or df.storageLevel.useMemory:
        yield df
        return
    kept = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """A derived table that several jobs read: computed once, in memory if small, else in the checkpoint folder."""
    if not fits_in_memory(df):
        yield materialise(df)
        return
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """Over all cores before costly per-row work; a large table has splits enough of its own."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if fits_in_memory(df) else df


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """A large table over tasks of a bounded number of rows, however it was split; one of a single task's rows as it is."""
    # by rows: joins make the estimate of a small table large
    if rows <= ROWS_PER_TASK:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK)))
