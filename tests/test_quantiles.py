"""Both routes to exact quantiles against pandas, with ties, gaps, hot values and hot groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from columnscope.functions.buckets import ValueBuckets
from columnscope.functions.quantiles import grouped_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def frame(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n)
    v[: n // 3] = 0.25  # one value holds a third of the rows
    g = rng.choice(["hot", "a", "b", None], n, p=[0.6, 0.2, 0.1, 0.1])
    pdf = pd.DataFrame({"g": g, "v": v, "w": rng.integers(0, 5, n).astype(float)})
    pdf.loc[rng.integers(0, n, n // 10), "v"] = np.nan
    return pdf


@pytest.mark.parametrize("route", ["window", "counted"])
def test_grouped(spark, request, route):
    if route == "counted":
        request.getfixturevalue("counted")
    pdf = frame()
    got = {r["g"]: r for r in grouped_quantiles(spark.createDataFrame(pdf), ["g"], ["v", "w"], PROBS).collect()}
    want = pdf.groupby("g", dropna=False)[["v", "w"]].quantile(PROBS)
    assert len(got) == 4
    for key, row in got.items():
        for c in ("v", "w"):
            expected = pdf[pdf["g"].isna() if key is None else pdf["g"] == key][c].quantile(PROBS)
            assert row[c] == pytest.approx(list(expected), abs=1e-12)
    assert len(want) == 4 * len(PROBS)


def test_global(spark, counted):
    pdf = frame()
    row = grouped_quantiles(spark.createDataFrame(pdf[["v", "w"]]), [], ["v", "w"], PROBS).first()
    assert row["v"] == pytest.approx(list(pdf["v"].quantile(PROBS)), abs=1e-12)
    assert row["w"] == pytest.approx(list(pdf["w"].quantile(PROBS)), abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6) | st.none() | st.sampled_from([0.0, -0.0, 1.0]), min_size=1, max_size=40))
def test_routes_agree_with_pandas(spark, counted, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = grouped_quantiles(df.selectExpr("v + 0d as v"), [], ["v"], [0.25, 0.5]).first()
    present = pd.Series([v for v in values if v is not None], dtype="float64")
    if present.empty:
        assert row["v"] is None
    else:
        assert row["v"] == pytest.approx(list(present.quantile([0.25, 0.5])), rel=1e-9, abs=1e-9)


def test_a_hot_value_has_its_own_range(spark):
    df = spark.createDataFrame(frame()[["v"]])
    buckets = ValueBuckets.fit(df, ["v"], 16)
    sizes = buckets.assign(df).where("v is not null").groupBy("v__range").count()
    open_sizes = [r[1] for r in sizes.collect() if r["v__range"] not in buckets.single_ids("v")]
    assert max(open_sizes) <= 2 * 4000 / 16
