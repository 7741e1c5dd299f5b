"""Profiles of growing tables: a stored state for each Parquet file, so that only files not seen before are read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.operators.sketches import column_states, estimates, merged

_FILE = ["file", "modified", "size"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Path, time and size of the Parquet files under ``path``, from their metadata."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def profile_of_files(spark: SparkSession, path: str, store: str) -> tuple[DataFrame, int]:
    """(the statistics of the table at ``path`` as ``estimates`` gives them, how many of its files were read).

    The states of the files are kept at ``store``. A file counts as seen while its path, time and size are the same: new
    and changed files are read, and states of files that are gone or have changed play no part. A store that two runs
    fill at once holds some states twice; each counts once.
    """
    files = _files(spark, path)
    try:
        held = spark.read.parquet(store)
        known = held.select(*_FILE).distinct()
        fresh = files.join(known, _FILE, "left_anti")
    except AnalysisException:  # nothing stored yet
        fresh = files
    new = [r["file"] for r in fresh.select("file").collect()]  # names of new files alone
    if new:
        rows = spark.read.parquet(*new).withColumn("__file", F.col("_metadata.file_path"))
        states = column_states(rows, by=["__file"])
        # the two spellings of a local file's address
        plain = F.regexp_replace("__file", "^file:/+", "file:/")
        named = files.withColumn("plain", F.regexp_replace("file", "^file:/+", "file:/"))
        states.withColumn("plain", plain).drop("__file").join(F.broadcast(named), "plain").drop("plain").write.mode("append").parquet(store)
    try:
        held = spark.read.parquet(store)
    except AnalysisException as e:
        raise ValidationError(f"No Parquet files with rows at {path!r}.") from e
    current = held.join(files, _FILE, "left_semi").dropDuplicates([*_FILE, "name"])
    return estimates(merged(current)), len(new)
