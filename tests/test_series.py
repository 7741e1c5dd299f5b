from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from columnscope.errors import ValidationError
from columnscope.operators.timeseries import backtest, fit_and_extend, forecast, forecast_summary, granularity


def daily(spark, n):
    days = pd.date_range("2025-01-01", periods=n)
    return spark.createDataFrame(pd.DataFrame({"d": days, "v": [10.0 + 2 * i for i in range(n)]}))


def ahead(df, **more):
    return [(str(r["date"].date()), r["value"]) for r in forecast(df, "d", "v", **more).where("kind = 'forecast'").collect()]


def test_linear(spark):
    df = daily(spark, 20)
    got = ahead(df, periods_ahead=2)
    assert got[0][0] == "2025-01-21" and [v for _, v in got] == pytest.approx([50.0, 52.0])
    assert len(ahead(df, periods_ahead=999)) == 24
    summary = forecast_summary(df, "d", "v").first()
    assert (summary["granularity"], summary["historical_periods"]) == ("D", 20)
    assert summary["backtest_mae"] == pytest.approx(0.0, abs=1e-9)


def test_other_methods(spark):
    df = daily(spark, 20)
    assert ahead(df, method="naive", periods_ahead=1) == [("2025-01-21", 48.0)]
    assert ahead(df, method="moving_average", periods_ahead=1) == [("2025-01-21", 46.0)]
    assert forecast_summary(df, "d", "v", "naive").first()["backtest_mae"] == 4.0


def smoothing(y, alpha):
    """(squared error, last level) with the best start, by its definition."""
    starts = np.linspace(min(y) - 2, max(y) + 2, 4001)
    level, error = starts.copy(), np.zeros_like(starts)
    for v in y:
        error += (v - level) ** 2
        level = alpha * v + (1 - alpha) * level
    best = error.argmin()
    return error[best], level[best]


def test_exponential_smoothing_is_the_least_squares_fit(spark):
    rng = np.random.default_rng(2)
    y = 20 + rng.normal(size=30).cumsum() * 0.3 + rng.normal(size=30)
    series = spark.createDataFrame(pd.DataFrame({"bucket": pd.date_range("2025-01-06", periods=30, freq="7D"), "value": y}))
    want = min(smoothing(y, a) for a in np.linspace(0, 1, 501))
    got = fit_and_extend(series, "exponential_smoothing", "W", 2).collect()
    assert [r["value"] for r in got] == pytest.approx([want[1]] * 2, abs=0.02)
    assert str(got[0]["date"].date()) == "2025-08-10"  # a Sunday, 13 days after the last Monday
    assert backtest(series, "exponential_smoothing").first()["backtest_mae"] > 0


def test_weekly_and_monthly(spark):
    got = ahead(daily(spark, 200), method="naive", periods_ahead=2, weekly_anchor="monday")
    assert [d for d, _ in got] == ["2025-07-21", "2025-07-28"]
    assert granularity(daily(spark, 200), "d") == "W"
    assert granularity(daily(spark, 800), "d") == "M"
    assert ahead(daily(spark, 800), method="naive", periods_ahead=1)[0][0] == "2027-04-01"


def test_refusals(spark):
    with pytest.raises(ValidationError):
        forecast(daily(spark, 3), "d", "v")
    with pytest.raises(ValidationError):
        forecast(daily(spark, 20), "d", "v", method="arima")
    with pytest.raises(ValidationError):
        forecast(daily(spark, 20), "nope", "v")
    with pytest.raises(ValidationError):
        forecast(spark.createDataFrame([("x", 1.0)], "d string, v double"), "d", "v")
