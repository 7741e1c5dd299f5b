"""Exact quantiles (linear interpolation), globally or per group, at any size.

Spark's ``percentile`` keeps every distinct value of a group in one boxed map in one task. Here values are
counted first (combined map-side) and the wanted ranks are located by running counts:

* small inputs: one window over the distinct values of a group;
* above a size limit no window may span a group, so
  1. the values are cut into equal-count ranges (``ValueBuckets``),
  2. rows are counted per (group, range) and the range holding each wanted rank is found,
  3. only rows of those ranges are looked at. A range holds about ``rows / buckets`` rows, or one repeated
     value, in which case no row is read at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from columnscope.functions.buckets import ValueBuckets, bucket_name
from columnscope.functions.columns import ref
from columnscope.functions.sizing import fits_in_memory, materialise


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join keeping one copy of the key columns."""
    renamed = right.select(
        *[ref(n).alias(f"__k{i}") for i, n in enumerate(names)],
        *[ref(c) for c in right.columns if c not in names],
    )
    condition = reduce(lambda a, b: a & b, [ref(n).eqNullSafe(ref(f"__k{i}")) for i, n in enumerate(names)])
    return left.join(renamed, condition, how).drop(*[f"__k{i}" for i in range(len(names))])


def grouped_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    """One row per group: the keys and, per column, an array of quantiles (NULL for a group without values).

    ``columns`` must be double columns with NULL for missing values.
    """
    slim = df.select(*[ref(k) for k in keys], *[ref(c) for c in columns])
    locate = _by_window if fits_in_memory(slim) else _by_ranges
    result = _interpolated(locate(slim, keys, columns, probs), keys, columns)
    if not keys:
        return result
    # Groups whose values are all missing are still groups.
    return join_same(slim.select(*[ref(k) for k in keys]).distinct(), result, keys, "left")


def _holding_wanted(counted: DataFrame, probs: list[float]) -> DataFrame:
    """Rows (value or range with ``__before``, ``__n``, ``__total``) that hold a wanted rank, one per rank.

    ``__r`` is (probability, zero-based rank, weight of that order statistic in the quantile).
    """

    def holds(rank: Column) -> Column:
        return (rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__n"))

    some, structs = None, []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("__total") - 1)
        low, high = F.floor(position), F.ceil(position)
        for rank, weight in ((low, high - position), (high, position - low)):
            some = holds(rank) if some is None else some | holds(rank)
            structs.append(F.struct(F.lit(i).alias("i"), rank.alias("rank"), weight.alias("weight")))
    return (
        counted.where(some)
        .select("*", F.explode(F.array(*structs)).alias("__r"))
        .where(holds(F.col("__r.rank")))
    )


def _by_window(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    key_cols = [ref(k) for k in keys]
    cells = [F.struct(F.lit(i).alias("__pos"), ref(c).alias("__value")) for i, c in enumerate(columns)]
    long = df.select(*key_cols, F.inline(F.array(*cells))).where("__value is not null")
    counts = long.groupBy(*key_cols, "__pos", "__value").agg(F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(*key_cols, "__pos")
    upto = group.orderBy("__value").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counts.select(
        "*",
        (F.sum("__n").over(upto) - F.col("__n")).alias("__before"),
        F.sum("__n").over(group).alias("__total"),
    )
    return _holding_wanted(placed, probs).select(*key_cols, "__pos", "__r", "__value")


def _by_ranges(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    key_cols = [ref(k) for k in keys]
    buckets = ValueBuckets.fit(df, columns)
    cells = [
        F.struct(
            F.lit(i).alias("__pos"),
            ref(c).alias("__value"),
            ref(bucket_name(c)).alias("__range"),
            buckets.is_single(c).alias("__single"),
        )
        for i, c in enumerate(columns)
    ]
    long = buckets.assign(df).select(*key_cols, F.inline(F.array(*cells))).where("__value is not null")

    ranges = long.groupBy(*key_cols, "__pos", "__range", "__single").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__value").alias("__value")
    )
    group = W.partitionBy(*key_cols, "__pos")
    upto = group.orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranges.select(
        "*",
        (F.sum("__n").over(upto) - F.col("__n")).alias("__before"),
        F.sum("__n").over(group).alias("__total"),
    )
    wanted = materialise(_holding_wanted(placed, probs))
    in_single = wanted.where("__single").select(*key_cols, "__pos", "__r", "__value")

    # A range is wanted by at most two ranks per probability, so these arrays stay tiny.
    cell = [*keys, "__pos", "__range"]
    cell_cols = [ref(c) for c in cell]
    open_ranges = (
        wanted.where("not __single")
        .groupBy(*cell_cols)
        .agg(
            F.collect_list("__r").alias("__rs"),
            F.first("__before").alias("__start"),
        )
    )
    counted = (
        join_same(long.drop("__single"), open_ranges, cell)
        .groupBy(*cell_cols, "__value")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.first("__rs").alias("__rs"),
            F.first("__start").alias("__start"),
        )
    )
    within = W.partitionBy(*cell_cols).orderBy("__value").rowsBetween(W.unboundedPreceding, W.currentRow)
    in_open = (
        counted.withColumn("__before", F.col("__start") + F.sum("__n").over(within) - F.col("__n"))
        .select("*", F.explode("__rs").alias("__r"))
        .where("__r.rank >= __before and __r.rank < __before + __n")
        .select(*key_cols, "__pos", "__r", "__value")
    )
    return in_single.unionByName(in_open)


def _interpolated(found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    key_cols = [ref(k) for k in keys]
    blend = F.sum(F.col("__r.weight") * F.col("__value"))
    # The grouping refines the window's partitioning, so it needs no shuffle of its own.
    each = found.groupBy(*key_cols, "__pos", F.col("__r.i").alias("__i")).agg(
        F.when(F.min("__value") == F.max("__value"), F.min("__value")).otherwise(blend).alias("__q")
    )
    outputs = []
    for pos, column in enumerate(columns):
        mine = F.array_sort(F.collect_list(F.when(F.col("__pos") == pos, F.struct("__i", "__q"))))
        values = F.transform(mine, lambda x: x["__q"])
        outputs.append(F.when(F.size(values) > 0, values).alias(column))
    return each.groupBy(*key_cols).agg(*outputs)
