"""As-of join: each left row with the latest right row at or before its time, within the same keys.

Time is cut into equal-count ranges. A left row's match is either in its own range or the last right row of an
earlier one; the latter is carried over a small table with one row per (keys, range). So a key that holds a
third of all rows is spread over the ranges instead of being one window partition, and rows that share one
instant, which fill a range of their own, need no window at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.buckets import ValueBuckets, bucket_name
from columnscope.functions.columns import as_number, is_temporal, ref, require_columns, type_of
from columnscope.functions.quantiles import join_same


def _instant(df: DataFrame, name: str):
    if is_temporal(type_of(df, name)):
        return F.unix_micros(ref(name).cast("timestamp")).cast("double")
    return as_number(df, name)


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], values: list[str]
) -> DataFrame:
    """Left rows with ``matched_<name>`` for the right time and ``values``; NULL where nothing is early enough."""
    require_columns(left, [left_time, *by])
    require_columns(right, [right_time, *by, *values])
    clash = {f"matched_{v}" for v in (right_time, *values)} & set(left.columns)
    if clash:
        raise ValidationError(f"Duplicate output columns: {sorted(clash)}")
    keys = [f"__by{i}" for i in range(len(by))]
    payload = F.struct(*[ref(c).alias(c) for c in dict.fromkeys([right_time, *values])])
    known = reduce(lambda a, b: a & b, [ref(c).isNotNull() for c in (right_time, *by)])
    seen = right.where(known).select(
        *[ref(c).alias(k) for c, k in zip(by, keys)], _instant(right, right_time).alias("__t"), payload.alias("__r")
    )
    asking = left.select(
        *[ref(c).alias(k) for c, k in zip(by, keys)], _instant(left, left_time).alias("__t"),
        F.struct(*[ref(c).alias(c) for c in left.columns]).alias("__l"),
    )
    both = asking.unionByName(seen, allowMissingColumns=True)
    buckets = ValueBuckets.fit(both.select("__t"), ["__t"])
    bucket, cell = bucket_name("__t"), [*keys, bucket_name("__t")]
    tagged = buckets.assign(both)

    ends = tagged.groupBy(*cell).agg(F.expr("max_by(__r, struct(__t, __r)) filter (where __r is not null)").alias("__own"))
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__carried", F.last("__own", ignorenulls=True).over(earlier))

    upto = W.partitionBy(*cell).orderBy("__t", F.col("__l").isNotNull(), "__r").rowsBetween(W.unboundedPreceding, W.currentRow)
    single = F.coalesce(buckets.is_single("__t"), F.lit(False))
    opened = (
        tagged.where(~single).withColumn("__found", F.last("__r", ignorenulls=True).over(upto)).where("__l is not null")
    )
    fixed = tagged.where(single).where("__l is not null").withColumn("__found", F.lit(None).cast(tagged.schema["__r"].dataType))
    answered = opened.withColumn("__one", F.lit(False)).unionByName(fixed.withColumn("__one", F.lit(True)))
    joined = join_same(answered.drop("__r"), ends, cell, "left")
    match = F.when(F.col("__t").isNotNull(), F.coalesce(
        F.when(F.col("__one"), F.col("__own")).otherwise(F.col("__found")), F.col("__carried")
    ))
    return joined.select("__l.*", match.alias("__m")).select(
        *[ref(c) for c in left.columns],
        *[F.col("__m")[c].alias(f"matched_{c}") for c in dict.fromkeys([right_time, *values])],
    )
