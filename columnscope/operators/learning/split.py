"""Exact train/test split, stratified by class where there are classes.

Rows are ordered by a hash; each class gives its lowest-hash rows to the test set. The hash is cut into
ranges, so only the one range a class's quota ends in has to be ordered -- no class is ever sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from columnscope.functions.columns import ROW_ID, ref

_RANGES = 4096


def allocate(counts: list[int], draws: int) -> list[int]:
    """Proportional share of ``draws`` per class; leftovers go to the largest remainders."""
    total = sum(counts)
    exact = [c * draws / total for c in counts]
    shares = [math.floor(e) for e in exact]
    by_remainder = sorted(range(len(counts)), key=lambda i: (shares[i] - exact[i], i))
    for i in by_remainder[: draws - sum(shares)]:
        shares[i] += 1
    return shares


def test_quota(counts: dict, test_size: float) -> dict:
    """Test rows per class for a test set of ``ceil(rows * test_size)``."""
    labels, sizes = list(counts), list(counts.values())
    total = sum(sizes)
    test_rows = math.ceil(total * test_size - 1e-9)
    train = allocate(sizes, total - test_rows)
    left = [n - t for n, t in zip(sizes, train)]
    return dict(zip(labels, allocate(left, test_rows)))


def split_rows(df: DataFrame, quota: dict, label: str | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test); ``quota`` maps each class (or None for a single stratum) to its number of test rows."""
    basis = [ref(ROW_ID)] if ROW_ID in df.columns else [ref(c) for c in df.columns]
    stratum = ref(label).cast("string") if label else F.lit("all")
    marked = df.select(
        "*", stratum.alias("__stratum"), F.xxhash64(F.lit(seed), *basis).alias("__hash")
    ).withColumn("__range", F.expr(f"pmod(shiftrightunsigned(__hash, 20), {_RANGES})"))

    upto = W.partitionBy("__stratum").orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = (
        marked.groupBy("__stratum", "__range").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
    )
    wanted = df.sparkSession.createDataFrame(
        [(str(k) if label else "all", int(v)) for k, v in quota.items()], "stratum string, quota long"
    )
    # One row per class: the range in which its quota is reached, and how many rows to take there.
    ends = (
        filled.join(wanted, F.col("__stratum") == F.col("stratum"))
        .where("upto >= quota and upto - n < quota")
        .select("stratum", F.col("__range").alias("end"), F.expr("quota - (upto - n)").alias("take"))
        .collect()
    )
    if not ends:
        empty = df.limit(0)
        return df, empty
    cut = df.sparkSession.createDataFrame([tuple(r) for r in ends], "stratum string, end long, take long")
    placed = marked.join(F.broadcast(cut), F.col("__stratum") == F.col("stratum"), "left")  # one row per class
    clear = placed.where("end is null or __range <> end").withColumn("__test", F.expr("coalesce(__range < end, false)"))
    # Copies of a row share a hash: they are counted, cut by count, and written out again.
    order = W.partitionBy("__stratum").orderBy("__hash", *[ref(c) for c in df.columns])
    border = (
        placed.where("__range = end")
        .groupBy(*[ref(c) for c in df.columns], "__stratum", "__hash", "take")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("in_test", F.expr("greatest(0, least(n, take - (upto - n)))"))
        .select(
            *[ref(c) for c in df.columns],
            F.expr("stack(2, true, in_test, false, n - in_test) as (__test, copies)"),
        )
        .where("copies > 0")
        .select(*[ref(c) for c in df.columns], "__test", F.expr("explode(sequence(1, copies))"))
        .select(*[ref(c) for c in df.columns], "__test")
    )
    everything = clear.select(*[ref(c) for c in df.columns], "__test").unionByName(border)
    keep = [ref(c) for c in df.columns]
    return everything.where("not __test").select(*keep), everything.where("__test").select(*keep)
