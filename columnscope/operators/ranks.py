"""Rank index: for every distinct value of every column, how many rows lie below it and how many share it.

All columns go through the same steps, so neither the number of shuffles nor of jobs depends on how many there are:

1. rows become cells (row, column, value), and equal cells are counted, combined in each task before the shuffle;
2. the distinct values are sorted by (column, value) over range partitions. Each task adds up its own range, and the totals of
   the ranges before it, one small row for each range and column, complete the sums;
3. ranks are joined back by (column, value): a small index goes to all tasks; with a large one the rows travel as cells, and values
   that very many rows share, which are few, are joined from a broadcast table first, so no task receives all rows of one value.

``below``, ``same`` are counted over all rows and once more over the rows in which another column is present, for
columns with gaps, as ranks of a pair are taken over the rows in which both are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from columnscope.functions.sizing import materialise

# A value is joined from the broadcast table if at least this share of a column's cells has it: so many values a column at most.
HEAVY_SHARE = 1 / 256
# An index up to this size may go to all tasks.
BROADCAST_BYTES = [128 * 1024 * 1024]
_ROW_BYTES = 100


def distinct_values(cells: DataFrame, weights: list[str]) -> DataFrame:
    """``pos, value, weights..., range`` of every distinct cell in order; the range is the task that holds it."""
    counted = cells.groupBy("pos", "value").agg(*[F.sum(w).alias(w) for w in weights])
    return materialise(counted.repartitionByRange("pos", "value").sortWithinPartitions("pos", "value").withColumn("range", F.spark_partition_id()))


def rank_index(values: DataFrame, weights: list[str]) -> DataFrame:
    """``pos, value, dense``, and for each weight ``w`` its ``w`` (rows with the value) and ``w_below`` (rows below it)."""
    names = [*weights, "one"]
    totals = values.withColumn("one", F.lit(1)).groupBy("pos", "range").agg(*[F.sum(w).alias(w) for w in names])
    before = W.partitionBy("pos").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("pos", "range", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_start") for w in names])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column("pos").to_numpy()
            new = np.r_[last is None or pos[0] != last, pos[1:] != pos[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
            out = [batch.column("pos"), batch.column("value"), batch.column("range")]
            for k, w in enumerate(names):
                x = batch.column(w).to_numpy() if w != "one" else np.ones(len(pos), np.int64)
                below = np.cumsum(x) - x
                own = below - below[first] + np.where(np.cumsum(new) == 0, carried[k], 0)
                carried[k] = own[-1] + x[-1]
                out += [pa.array(x), pa.array(own)] if w != "one" else [pa.array(own)]
            last = pos[-1]
            yield pa.RecordBatch.from_arrays(out, names=["pos", "value", "range", *[c for w in weights for c in (w, f"{w}_below")], "dense"])

    schema = "pos int, value double, range int, " + ", ".join(f"{w} long, {w}_below long" for w in weights) + ", dense long"
    own = values.mapInArrow(summed, schema)
    # one row for each range and column
    found = own.join(F.broadcast(starts), ["pos", "range"])
    return found.select(
        "pos", "value", (F.col("dense") + F.col("one_start")).alias("dense"),
        *[c for w in weights for c in (F.col(w), (F.col(f"{w}_below") + F.col(f"{w}_start")).alias(f"{w}_below"))],
    )


def ranked_cells(cells: DataFrame, index: DataFrame, weight: str) -> DataFrame:
    """``cells`` (row, pos, value) with the columns of the index."""
    share = index.select("pos", "value", weight).groupBy("pos").agg(F.sum(weight).alias("all"))
    heavy = index.join(F.broadcast(share), "pos").where(F.col(weight) >= F.greatest(F.lit(2), F.col("all") * HEAVY_SHARE)).drop("all")
    facts = [c for c in index.columns if c not in ("pos", "value")]
    met = cells.join(F.broadcast(heavy.select("pos", "value", F.struct(*facts).alias("found"))), ["pos", "value"], "left")
    # a cell that is settled gets a key that no value has and that differs from row to row, so it goes anywhere
    settled = F.col("found").isNotNull()
    met = met.withColumn("key_pos", F.when(settled, (F.lit(-1) - F.pmod(F.xxhash64("row"), F.lit(1 << 30))).cast("int")).otherwise(F.col("pos")))
    met = met.withColumn("key_value", F.when(settled, F.lit(0.0)).otherwise(F.col("value")))
    light = index.select(F.col("pos").alias("key_pos"), F.col("value").alias("key_value"), F.struct(*facts).alias("own"))
    fact = F.coalesce("found", "own")
    return met.join(light, ["key_pos", "key_value"], "left").select(*cells.columns, *[fact[c].alias(c) for c in facts])


def cells_of(rows: DataFrame, width: int, *others: str) -> DataFrame:
    cells = ", ".join(f"{i}, c{i}" for i in range(width))
    return rows.selectExpr(*others, f"stack({width}, {cells}) as (pos, value)").where("value is not null")


def ranked_rows(numbers: DataFrame, width: int, index: DataFrame, weight: str, facts: list[str]) -> DataFrame:
    """``w`` and, for each fact f of the index, ``f_0, f_1, ...``: rows of c0, c1, ... (``w`` equal ones); null for a missing value.

    An index of a proven small size goes to all tasks and no row is shuffled. Otherwise equal rows are added up, and
    shuffled once as cells and once back to rows.
    """
    if index.count() * _ROW_BYTES <= BROADCAST_BYTES[0]:
        rows = numbers
        for i in range(width):
            own = index.where(F.col("pos") == i).select(F.col("value").alias(f"c{i}"), *[F.col(f).alias(f"{f}_{i}") for f in facts])
            rows = rows.join(F.broadcast(own), f"c{i}", "left")
        return rows.select(F.lit(1).cast("long").alias("w"), *[f"{f}_{i}" for i in range(width) for f in facts])
    joint = numbers.groupBy(*numbers.columns).agg(F.count(F.lit(1)).alias("w"))
    joint = materialise(joint.withColumn("row", F.monotonically_increasing_id()))
    found = ranked_cells(cells_of(joint, width, "row", "w as own_w"), index, weight)
    return found.groupBy("row").agg(
        F.max("own_w").alias("w"), *[F.max(F.when(F.col("pos") == i, F.col(f))).alias(f"{f}_{i}") for i in range(width) for f in facts]
    )
