"""Time bucketing and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnscope.operators.timeseries import bucketed_series, forecast, forecast_summary, granularity
from columnscope.plans.base import dated, rounded, table


def _stretched(spark, folder):
    """Events spread over eight times their span, so that they fall into weekly buckets."""
    origin = "unix_micros(timestamp'2024-01-01 00:00:00')"
    return table(spark, folder, "events").selectExpr(
        f"timestamp_micros(unix_micros(cast(ts as timestamp)) * 8 - 7 * {origin}) as moment", "value"
    )


STRETCHED = (
    "(SELECT make_timestamp(epoch_us(ts) * 8 - 7 * epoch_us(TIMESTAMP '2024-01-01')) AS moment, value FROM events)"
)
DAY = "strftime({}, '%Y-%m-%d')"
MONTHLY = "SELECT date_trunc('month', o_orderdate) AS b, sum(o_totalprice) AS v FROM orders GROUP BY 1"
WEEKLY = f"SELECT date_trunc('week', moment) AS b, avg(value) AS v FROM {STRETCHED} t GROUP BY 1"
INDEXED = "SELECT b, v, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS n FROM s"


def _forecast(method):
    return lambda spark, folder: rounded(dated(
        forecast(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", method=method), "date"
    ), 1)


def _forecast_sql(value: str, series: str = MONTHLY, step: str = "b + to_months(CAST(k AS INTEGER))") -> str:
    """History plus six periods; ``value`` is written over the indexed series ``x`` and the step ``k``."""
    return (
        f"WITH s AS ({series}), x AS ({INDEXED}), e AS (SELECT max(b) AS b FROM s) "
        f"SELECT {DAY.format('b')} AS date, round(v, 1) AS value, 'historical' AS kind FROM s UNION ALL "
        f"SELECT {DAY.format(step)} AS date, round(({value}), 1) AS value, 'forecast' AS kind "
        "FROM e, range(1, 7) r(k)"
    )


LINEAR = "SELECT regr_intercept(v, i) + regr_slope(v, i) * (max(n) - 1 + k) FROM x"

ENTRIES = {
    "granularity": (
        lambda spark, folder: spark.createDataFrame(
            [(granularity(table(spark, folder, "events"), "ts"), granularity(_stretched(spark, folder), "moment"),
              granularity(table(spark, folder, "orders"), "o_orderdate"))],
            "events string, stretched string, orders string",
        ),
        "SELECT " + ", ".join(
            f"(SELECT CASE WHEN d <= 60 THEN 'D' WHEN d <= 730 THEN 'W' ELSE 'M' END FROM (SELECT "
            f"floor(date_diff('second', min({c}), max({c})) / 86400) AS d FROM {t} t)) AS {n}"
            for n, t, c in (("events", "events", "ts"), ("stretched", STRETCHED, "moment"), ("orders", "orders", "o_orderdate"))
        ),
    ),
    "bucket_day": (
        lambda spark, folder: rounded(dated(bucketed_series(table(spark, folder, "events"), "ts", "value", "sum"), "bucket"), 3),
        f"SELECT {DAY.format('ts')} AS bucket, round(sum(value), 3) AS value FROM events GROUP BY 1",
    ),
    "bucket_week": (
        lambda spark, folder: rounded(dated(bucketed_series(_stretched(spark, folder), "moment", "value", "mean"), "bucket"), 3),
        f"SELECT {DAY.format('b')} AS bucket, round(v, 3) AS value FROM ({WEEKLY})",
    ),
    "bucket_month_median": (
        lambda spark, folder: rounded(dated(
            bucketed_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "median"), "bucket"
        ), 3),
        f"SELECT {DAY.format('b')} AS bucket, v AS value FROM (SELECT date_trunc('month', o_orderdate) AS b, "
        "round(median(o_totalprice), 3) AS v FROM orders GROUP BY 1)",
    ),
    "bucket_text_dates": (
        lambda spark, folder: dated(bucketed_series(
            table(spark, folder, "orders").select(
                F.expr("if(o_orderkey % 20 = 0, 'unknown', date_format(o_orderdate, 'M/d/yyyy'))").alias("day"), "o_orderkey"
            ), "day", "o_orderkey", "count",
        ), "bucket"),
        f"SELECT {DAY.format('b')} AS bucket, CAST(n AS DOUBLE) AS value FROM (SELECT date_trunc('month', o_orderdate) "
        "AS b, count(*) AS n FROM orders WHERE o_orderkey % 20 <> 0 GROUP BY 1)",
    ),
    "forecast_naive": (_forecast("naive"), _forecast_sql("SELECT max_by(v, b) FROM s")),
    "forecast_moving_average": (
        _forecast("moving_average"), _forecast_sql("SELECT avg(v) FROM x WHERE i >= n - 3")
    ),
    "forecast_linear": (_forecast("linear"), _forecast_sql(LINEAR)),
    "forecast_weekly": (
        lambda spark, folder: rounded(dated(
            forecast(_stretched(spark, folder), "moment", "value", method="linear", aggregation="mean"), "date"
        ), 1),
        _forecast_sql(LINEAR, WEEKLY, "b + to_days(CAST(6 + 7 * k AS INTEGER))"),
    ),
    "forecast_smoothing": (_forecast("exponential_smoothing"), None),
    "backtest_linear": (
        lambda spark, folder: rounded(forecast_summary(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "linear"), 1),
        f"WITH s AS ({MONTHLY}), x AS ({INDEXED}), m AS (SELECT regr_slope(v, i) AS a, regr_intercept(v, i) AS c FROM x "
        "WHERE i < n - 3) SELECT 'linear' AS method, 'M' AS granularity, 'o_orderdate' AS date_column, 'o_totalprice' AS "
        "value_column, CAST(max(n) AS INTEGER) AS historical_periods, round(avg(abs(c + a * i - v)), 1) AS backtest_mae "
        "FROM x, m WHERE i >= n - 3",
    ),
    "backtest_moving_average": (
        lambda spark, folder: rounded(forecast_summary(
            table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "moving_average"
        ), 1),
        f"WITH s AS ({MONTHLY}), x AS ({INDEXED}), m AS (SELECT avg(v) AS c FROM x WHERE i < n - 3 AND i >= n - 6) "
        "SELECT 'moving_average' AS method, 'M' AS granularity, 'o_orderdate' AS date_column, 'o_totalprice' AS "
        "value_column, CAST(max(n) AS INTEGER) AS historical_periods, round(avg(abs(c - v)), 1) AS backtest_mae "
        "FROM x, m WHERE i >= n - 3",
    ),
}
