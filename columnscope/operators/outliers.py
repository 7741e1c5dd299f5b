"""Univariate outliers by IQR fences or z-score, all columns in shared passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import as_number, ref, require_numeric
from columnscope.functions.sizing import shared_scan
from columnscope.operators.profile import column_quantiles, fence_bounds, pct
from columnscope.operators.query import row_order

METHODS = ("iqr", "zscore")
SAMPLE_ROWS = 20
Z_LIMIT = 3.0


@dataclass(frozen=True)
class Limits:
    """The one-row statistics a value is judged by; they travel to the tasks as literals."""

    method: str
    center: float = 0.0
    spread: float = 0.0
    low: float = 0.0
    high: float = 0.0

    def deviation(self, value: Column) -> Column:
        """Positive for an outlier only: distance beyond the fence, or |z|."""
        if self.method == "iqr":
            return F.greatest(value - self.high, F.lit(self.low) - value, F.lit(0.0))
        z = F.abs(value - self.center) / self.spread
        return F.when(z > Z_LIMIT, z).otherwise(F.lit(0.0))


def _check(df: DataFrame, columns: list[str] | None, method: str) -> list[str]:
    names = require_numeric(df, columns)
    if method not in METHODS:
        raise ValidationError(f"Unsupported outlier method: {method!r}")
    return names


def outlier_limits(df: DataFrame, names: list[str], method: str) -> dict[str, Limits]:
    """Limits per column; columns without spread have none."""
    if not names:
        return {}
    if method == "iqr":
        found = {}
        for name, q in column_quantiles(df, names).items():
            bounds = fence_bounds(q[0], q[2]) if q else None
            if bounds:
                found[name] = Limits("iqr", low=bounds[0], high=bounds[1])
        return found
    exprs = []
    for i, name in enumerate(names):
        exprs += [F.avg(as_number(df, name)).alias(f"m{i}"), F.stddev_samp(as_number(df, name)).alias(f"s{i}")]
    row = df.agg(*exprs).first()
    return {
        name: Limits("zscore", center=row[f"m{i}"], spread=row[f"s{i}"])
        for i, name in enumerate(names)
        if row[f"s{i}"]
    }


def outlier_summary(df: DataFrame, columns: list[str] | None = None, method: str = "iqr") -> DataFrame:
    """``column, method, outlier_count, outlier_percentage`` (of the non-missing values)."""
    names = _check(df, columns, method)
    with shared_scan(df) as table:
        limits = outlier_limits(table, names, method)
        exprs = [F.lit(0).alias("none")]
        for i, name in enumerate(names):
            value = as_number(table, name)
            exprs.append(F.count(value).alias(f"n{i}"))
            if name in limits:
                exprs.append(F.count_if(limits[name].deviation(value) > 0).alias(f"o{i}"))
        row = table.agg(*exprs).first().asDict()
    rows = []
    for i, name in enumerate(names):
        found = row.get(f"o{i}", 0)
        rows.append((name, method, found, pct(found, row[f"n{i}"])))
    return df.sparkSession.createDataFrame(
        rows, "column string, method string, outlier_count long, outlier_percentage double"
    )


def outlier_rows(
    df: DataFrame, columns: list[str] | None = None, method: str = "iqr", limit: int = SAMPLE_ROWS
) -> DataFrame:
    """The ``limit`` most extreme full rows of each column: ``outlier_column, deviation, rank`` + all columns.

    One scan for all columns: a row becomes one entry per column it is an outlier in (usually none), and the
    rank limit is applied inside each task before the shuffle.
    """
    names = _check(df, columns, method)
    limits = outlier_limits(df, names, method)
    entries = [
        F.struct(F.lit(n).alias("column"), limits[n].deviation(as_number(df, n)).alias("deviation"))
        for n in names if n in limits
    ]
    if not entries:
        entries = [F.struct(F.lit("").alias("column"), F.lit(0.0).alias("deviation"))]
    flagged = df.select(
        "*", F.explode(F.filter(F.array(*entries), lambda e: e["deviation"] > 0)).alias("__e")
    )
    order = W.partitionBy("__e.column").orderBy(F.col("__e.deviation").desc(), *row_order(df))
    return (
        flagged.withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") <= limit)
        .select(
            F.col("__e.column").alias("outlier_column"),
            F.col("__e.deviation").alias("deviation"),
            F.col("__rank").alias("rank"),
            *[ref(c) for c in df.columns],
        )
    )


def flag_outliers(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """Every row with ``is_outlier`` and ``deviation`` for one column; a pure projection once limits are known."""
    (name,) = _check(df, [column], method)
    limits = outlier_limits(df, [name], method).get(name)
    deviation = F.coalesce(limits.deviation(as_number(df, name)), F.lit(0.0)) if limits else F.lit(0.0)
    return df.select("*", deviation.alias("deviation"), (deviation > 0).alias("is_outlier"))
