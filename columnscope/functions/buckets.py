"""Equal-count value ranges: the building block for exact order statistics without a one-task sort.

``fit`` cuts each column at quantiles of sketches that are merged in two levels (a bounded list comes to the driver). Every
cut value becomes a range of its own, so a value shared by a third of all rows sits alone in a *single*
range, and every other range holds about ``rows / buckets`` rows whatever the distribution. The cuts only
decide balance; results computed from the ranges are exact for any cuts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from columnscope.functions.columns import ref
from columnscope.functions.sizing import bucket_target

SUFFIX = "__range"
# Items of a quantile sketch: a range's share of the rows is off by about two parts in so many.
_LEAST_ITEMS, _MOST_ITEMS = 2_000, 65_535


def bucket_name(column: str) -> str:
    return column + SUFFIX


@dataclass(frozen=True)
class ValueBuckets:
    splits: dict[str, list[float]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str], target: int | None = None) -> ValueBuckets:
        """``columns`` must be double columns with NULL (not NaN) for missing values."""
        count = target or bucket_target(df)
        probs = F.expr(f"array({', '.join(f'{i / count!r}d' for i in range(1, count))})")
        # sketches of tasks are merged in groups first, so that no task merges those of all
        items = min(_MOST_ITEMS, max(_LEAST_ITEMS, 4 * count))
        numbers = df.select(*[ref(c).alias(f"c{i}") for i, c in enumerate(columns)])
        tasks = max(1, math.isqrt(bucket_target(df)))
        partial = numbers.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(tasks))).groupBy("task").agg(
            *[F.kll_sketch_agg_double(c, items).alias(c) for c in numbers.columns], *[F.count(c).alias(f"n_{c}") for c in numbers.columns]
        )
        whole = partial.agg(*[F.kll_merge_agg_double(c).alias(c) for c in numbers.columns], *[F.sum(f"n_{c}").alias(f"n_{c}") for c in numbers.columns])
        row = whole.select(*[F.when(F.col(f"n_{c}") > 0, F.kll_sketch_get_quantile_double(F.when(F.col(f"n_{c}") > 0, F.col(c)), probs)).alias(c) for c in numbers.columns]).first()
        splits = {}
        for i, column in enumerate(columns):
            cuts = set()
            for cut in row[f"c{i}"] or []:
                if math.isfinite(cut):
                    cuts.update((cut, math.nextafter(cut, math.inf)))
            cuts.discard(math.inf)
            splits[column] = [-math.inf, *sorted(cuts or {0.0}), math.inf]
        return ValueBuckets(splits)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``<column>__range`` (int, NULL for a missing value) for every fitted column."""
        columns = list(self.splits)
        raw = [f"{bucket_name(c)}_raw" for c in columns]
        tagged = Bucketizer(
            splitsArray=[self.splits[c] for c in columns],
            inputCols=columns,
            outputCols=raw,
            handleInvalid="keep",
        ).transform(df)
        for column, name in zip(columns, raw):
            tagged = tagged.withColumn(
                bucket_name(column), F.when(ref(column).isNotNull(), ref(name).cast("int"))
            ).drop(name)
        return tagged

    def single_ids(self, column: str) -> list[int]:
        """Ranges that can hold one value only."""
        cuts = self.splits[column]
        return [i for i in range(1, len(cuts) - 2) if cuts[i + 1] == math.nextafter(cuts[i], math.inf)]

    def is_single(self, column: str) -> Column:
        """Ranges nearly always alternate (open, one value, open, ...): then the odd ones hold one value."""
        ids = self.single_ids(column)
        cuts = len(self.splits[column])
        if ids == list(range(1, cuts - 2, 2)):
            return ref(bucket_name(column)) % 2 == 1
        return ref(bucket_name(column)).isin(ids)
