"""Time bucketing and baseline forecasts with a backtest.

A series has at most one row per day (spans up to 60 days), week (up to 730) or month, so everything after
the bucketing aggregate works on a few hundred rows whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import as_number, ref, require_columns, type_of
from columnscope.functions.scalar import granularity_for, parse_timestamp, period_start, whole_days
from columnscope.operators.query import AGGREGATIONS, aggregate

METHODS = ("naive", "moving_average", "linear", "exponential_smoothing")
MIN_PERIODS = 5
DEFAULT_HORIZON = 6
MAX_HORIZON = 24
HOLDOUT = 3
MOVING_WINDOW = 3
_ALPHA_STEPS = 1000


def time_span(df: DataFrame, date_column: str) -> int | None:
    """Whole days between the first and last readable date; None when there is none. One small aggregate."""
    moment = parse_timestamp(ref(date_column), type_of(df, date_column))
    return df.select(moment.alias("m")).agg(whole_days(F.min("m"), F.max("m")).alias("days")).first()["days"]


def granularity(df: DataFrame, date_column: str) -> str:
    require_columns(df, [date_column])
    return granularity_for(time_span(df, date_column))


def bucketed_series(
    df: DataFrame, date_column: str, value_column: str, aggregation: str = "sum", unit: str | None = None
) -> DataFrame:
    """``bucket, value`` per day, week or month; rows without a readable date are dropped, gaps stay gaps."""
    require_columns(df, [date_column, value_column])
    if aggregation not in AGGREGATIONS:
        raise ValidationError(f"Unsupported aggregation: {aggregation!r}")
    unit = unit or granularity(df, date_column)
    moment = parse_timestamp(ref(date_column), type_of(df, date_column))
    rows = df.select(period_start(moment, unit).alias("bucket"), as_number(df, value_column).alias("v"))
    metric = {"aggregation": aggregation, "column": "v", "alias": "value"}
    series = aggregate(rows.where("bucket is not null"), ["bucket"], [metric])
    return series.select("bucket", F.col("value").cast("double").alias("value"))


def _indexed(series: DataFrame) -> DataFrame:
    """Add ``idx`` 0..n-1 and ``n``; a series is small, so one window partition is right."""
    whole = W.partitionBy(F.lit(0))
    return series.select(
        "bucket", "value",
        (F.row_number().over(whole.orderBy("bucket")) - 1).alias("idx"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )


# The level simple exponential smoothing ends at. For a given alpha the level after t values is
# ``a + b * start`` and every one-step error is linear in ``start``, so the fold over the ordered values carries
# (a, b, sum ab, sum bb, sum aa) and the best start and its squared error follow in closed form.
_SMOOTHING_FOLD = (
    "aggregate(ys, named_struct('a', 0d, 'b', 1d, 'ab', 0d, 'bb', 0d, 'aa', 0d), (s, y) -> named_struct("
    "'a', alpha * y + (1 - alpha) * s.a, 'b', (1 - alpha) * s.b, 'ab', s.ab + s.b * (y - s.a), "
    "'bb', s.bb + s.b * s.b, 'aa', s.aa + (y - s.a) * (y - s.a)))"
)


def _best_smoothing(candidates: DataFrame) -> DataFrame:
    """One row: the (sse, alpha, level) with the smallest squared error among rows of ``n, ys, alpha``."""
    fitted = candidates.select("n", "ys", "alpha", F.expr(_SMOOTHING_FOLD).alias("s"))
    found = F.expr("struct(s.aa - s.ab * s.ab / s.bb as sse, alpha, s.a + s.b * s.ab / s.bb as level)")
    return fitted.groupBy("n", "ys").agg(F.min(found).alias("best"))


def _smoothing(train: DataFrame) -> DataFrame:
    """Alpha from a grid of a thousand, then refined around the best one."""
    ordered = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("transform(array_sort(collect_list(struct(idx, value)) filter (where value is not null)), p -> p.value)").alias("ys"),
    )
    coarse = _best_smoothing(
        ordered.selectExpr("n", "ys", f"explode(sequence(0, {_ALPHA_STEPS})) as k")
        .selectExpr("n", "ys", f"k / {_ALPHA_STEPS}d as alpha")
    )
    fine = _best_smoothing(
        coarse.selectExpr("n", "ys", "best.alpha as near", "explode(sequence(-100, 100)) as k")
        .selectExpr("n", "ys", f"near + k / {_ALPHA_STEPS * 100}d as alpha")
        .where("alpha between 0 and 1")
    )
    return fine.selectExpr("n", "0d as slope", "best.level as level")


def _model(train: DataFrame, method: str) -> DataFrame:
    """One row ``n, slope, level``: the forecast for index t is ``level + slope * t``.

    A bucket without a value counts as a step of time but is left out of every fit; the moving average is that of the
    values among the last buckets.
    """
    n = F.count(F.lit(1)).alias("n")
    if method == "naive":
        return train.agg(n, F.lit(0.0).alias("slope"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("idx"))).alias("level"))
    if method == "moving_average":
        last = F.when(F.col("idx") >= F.col("n") - MOVING_WINDOW, F.col("value"))
        return train.agg(n, F.lit(0.0).alias("slope"), F.avg(last).alias("level"))
    if method == "linear":
        return train.agg(
            n, F.regr_slope("value", "idx").alias("slope"), F.regr_intercept("value", "idx").alias("level")
        )
    return _smoothing(train)


def _checked(method: str) -> None:
    if method not in METHODS:
        raise ValidationError(f"Unsupported forecasting method: {method!r}. Choose from {sorted(METHODS)}.")


def fit_and_extend(
    series: DataFrame, method: str, unit: str, periods: int, weekly_anchor: str = "sunday"
) -> DataFrame:
    """``date, value`` of the next ``periods`` buckets of a ``bucket, value`` series.

    Weekly dates fall on Sundays, the first one 13 days after the last Monday bucket, as users of the reference
    know them; ``weekly_anchor="monday"`` gives the Mondays that follow the last bucket.
    """
    _checked(method)
    if weekly_anchor not in ("sunday", "monday"):
        raise ValidationError(f"Unsupported weekly anchor: {weekly_anchor!r}")
    shift = 6 if weekly_anchor == "sunday" else 0
    indexed = _indexed(series)
    last = indexed.agg(F.max("bucket").alias("last"))
    step = {
        "D": "last + make_interval(0, 0, 0, k)",
        "W": f"last + make_interval(0, 0, 0, {shift} + 7 * k)",
        "M": "last + make_interval(0, k)",
    }[unit]
    return (
        _model(indexed, method).join(last, F.lit(True))  # one row each
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("k"))
        .selectExpr(f"{step} as date", "level + slope * (n - 1 + k) as value")
    )


def backtest(series: DataFrame, method: str) -> DataFrame:
    """One row ``backtest_mae``: error on the last (up to 3) buckets of a fit on the others; NULL if too short."""
    _checked(method)
    indexed = _indexed(series).withColumn("h", F.expr(f"least({HOLDOUT}, greatest(0, n - {MIN_PERIODS}))"))
    train = indexed.where("idx < n - h").withColumn("n", F.col("n") - F.col("h"))
    test = indexed.where("idx >= n - h")
    model = _model(train, method).select("slope", "level")
    return test.join(model, F.lit(True)).agg(F.avg(F.expr("abs(level + slope * idx - value)")).alias("backtest_mae"))


def _series_for(df: DataFrame, date_column: str, value_column: str, method: str, aggregation: str) -> tuple[DataFrame, str, int]:
    _checked(method)
    require_columns(df, [date_column, value_column])
    span = time_span(df, date_column)
    if span is None:
        raise ValidationError(f"{date_column!r} has no parseable dates.")
    unit = granularity_for(span)
    series = bucketed_series(df, date_column, value_column, aggregation, unit)
    rows = series.orderBy("bucket").collect()  # bounded by the bucketing rule
    if len(rows) < MIN_PERIODS:
        raise ValidationError(
            f"Not enough historical data to forecast: {len(rows)} period(s) found "
            f"after aggregating by {date_column!r}, at least {MIN_PERIODS} are required."
        )
    # The table has been reduced to this short list; the fits below must not scan it again.
    return df.sparkSession.createDataFrame(rows, series.schema), unit, len(rows)


def forecast(
    df: DataFrame,
    date_column: str,
    value_column: str,
    periods_ahead: int = DEFAULT_HORIZON,
    method: str = "linear",
    aggregation: str = "sum",
    weekly_anchor: str = "sunday",
) -> DataFrame:
    """``date, value, kind`` with the historical buckets and the forecast ones."""
    series, unit, _ = _series_for(df, date_column, value_column, method, aggregation)
    horizon = max(1, min(periods_ahead, MAX_HORIZON))
    history = series.select(F.col("bucket").alias("date"), "value", F.lit("historical").alias("kind"))
    ahead = fit_and_extend(series, method, unit, horizon, weekly_anchor).select("date", "value", F.lit("forecast").alias("kind"))
    return history.unionByName(ahead).orderBy("date")


def forecast_summary(
    df: DataFrame, date_column: str, value_column: str, method: str = "linear", aggregation: str = "sum"
) -> DataFrame:
    """One row: method, granularity, columns, historical_periods, backtest_mae."""
    series, unit, periods = _series_for(df, date_column, value_column, method, aggregation)
    return backtest(series, method).select(
        F.lit(method).alias("method"), F.lit(unit).alias("granularity"), F.lit(date_column).alias("date_column"),
        F.lit(value_column).alias("value_column"), F.lit(periods).alias("historical_periods"), "backtest_mae",
    )
