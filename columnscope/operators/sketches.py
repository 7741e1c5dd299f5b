"""Approximate statistics that add up: what is known of each column is a small state, and states of parts make that of the whole.

An opt-in beside the exact profile, never chosen by size. Counts, means, deviations and extremes are exact; the number of distinct
values is estimated by a HyperLogLog sketch and quantiles by a KLL sketch, both with their error beside them. States are rows of
bounded size, so that they can be stored for each file or day and merged later without reading the data again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from columnscope.functions.columns import as_number, is_missing, is_numeric, ref, type_of, user_columns
from columnscope.operators.counting import rendered

LOG_BUCKETS = 12
QUANTILE_ITEMS = 200
STATE = ["position", "name", "rows", "missing", "count", "mean", "spread", "min", "max", "distinct_sketch", "quantile_sketch"]


def distinct_error(log_buckets: int = LOG_BUCKETS) -> float:
    """Relative standard error of a count of distinct values."""
    return 1.04 / 2 ** (log_buckets / 2)


def rank_error(items: int = QUANTILE_ITEMS) -> float:
    """A quantile's rank is off by at most this share of the rows, with 99 % confidence."""
    return 2.296 / items ** 0.9723


def _cells(df: DataFrame, names: list[str]) -> list[Column]:
    out: list[Column] = []
    for position, name in enumerate(names):
        numeric = is_numeric(type_of(df, name))
        number = as_number(df, name) if numeric else F.lit(None).cast("double")
        item = number if numeric else rendered(df, name)
        out += [F.lit(position), F.lit(name), ~is_missing(df, name), number, F.xxhash64(item)]
    return out


def column_states(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, *, log_buckets: int = LOG_BUCKETS, items: int = QUANTILE_ITEMS) -> DataFrame:
    """One state for each column, and each combination of ``by`` if given; one aggregation that is combined in each task first."""
    by = by or []
    names = [c for c in (columns or user_columns(df)) if c not in by]
    long = df.select(*[ref(b) for b in by], F.stack(F.lit(len(names)), *_cells(df, names)).alias("position", "name", "filled", "number", "item"))
    return long.groupBy(*[ref(b) for b in by], "position", "name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("filled")).alias("missing"), F.count("number").alias("count"), F.avg("number").alias("mean"),
        (F.var_pop("number") * F.count("number")).alias("spread"), F.min("number").alias("min"), F.max("number").alias("max"),
        F.hll_sketch_agg(F.when(F.col("filled"), F.col("item")), log_buckets).alias("distinct_sketch"), F.kll_sketch_agg_double("number", items).alias("quantile_sketch"),
    )


def merged(states: DataFrame) -> DataFrame:
    """States of one table from those of its parts. Parts are told apart by ``name`` only; sketches must be of one size."""
    whole = W.partitionBy("name")
    mean = F.sum(F.col("mean") * F.col("count")).over(whole) / F.nullif(F.sum("count").over(whole), F.lit(0))
    centred = states.withColumn("all_mean", mean)
    off = F.col("mean") - F.col("all_mean")
    return centred.groupBy("name").agg(
        F.min("position").alias("position"), *[F.sum(c).alias(c) for c in ("rows", "missing", "count")], F.first("all_mean").alias("mean"),
        F.sum(F.col("spread") + F.col("count") * off * off).alias("spread"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    ).select(*STATE)


def estimates(states: DataFrame, log_buckets: int = LOG_BUCKETS, items: int = QUANTILE_ITEMS) -> DataFrame:
    """The statistics a state holds, one row a column; null where a column has no numbers."""
    held = F.when(F.col("count") > 0, F.col("quantile_sketch"))
    quantiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return states.select(
        "position", "name", "rows", "missing", "count", "mean", F.sqrt(F.try_divide("spread", F.col("count") - 1)).alias("std"), "min", "max",
        F.hll_sketch_estimate("distinct_sketch").alias("distinct"), F.lit(distinct_error(log_buckets)).alias("distinct_error"),
        *[F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double(held, F.lit(q))).alias(c) for c, q in quantiles.items()],
        F.lit(rank_error(items)).alias("rank_error"),
    )


def approximate_profile(df: DataFrame, columns: list[str] | None = None, *, log_buckets: int = LOG_BUCKETS, items: int = QUANTILE_ITEMS) -> DataFrame:
    return estimates(column_states(df, columns, log_buckets=log_buckets, items=items), log_buckets, items)
