from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import columnscope.operators.correlation as correlation_module
from columnscope.errors import ValidationError
from columnscope.operators import ranks
from columnscope.operators.correlation import count_concordant, correlation, pair_coefficients, strong_pairs
from columnscope.operators.outliers import flag_outliers, outlier_rows, outlier_summary


def tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    below = np.sqrt((dx**2).sum() * (dy**2).sum())
    return (dx * dy).sum() / below if below else np.nan


@pytest.fixture(scope="module")
def tied():
    """Ties, gaps, a hot value, a constant."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=300).round(1), "b": rng.integers(0, 8, 300).astype(float), "c": rng.normal(size=300)})
    pdf.loc[rng.integers(0, 300, 40), "b"] = np.nan
    pdf.loc[:120, "a"] = 0.5
    pdf["d"] = pdf["a"] * 2 + rng.normal(size=300) * 0.1
    pdf["k"] = 3.0
    return pdf


@pytest.mark.parametrize("method, limit", [("pearson", 0), ("spearman", 0), ("kendall", 0), ("spearman", 1 << 30), ("kendall", 1 << 30)])
def test_against_brute_force(spark, tied, monkeypatch, method, limit):
    monkeypatch.setattr(ranks, "BROADCAST_BYTES", [limit])
    names = list(tied.columns)
    got = pair_coefficients(spark.createDataFrame(tied), names, method)
    for (i, j), r in got.items():
        both = pd.DataFrame({"x": tied[names[i]], "y": tied[names[j]]}).dropna()
        x, y = both["x"], both["y"]
        if method == "kendall":
            want = tau_b(x.to_numpy(), y.to_numpy())
        else:
            want = x.rank().corr(y.rank()) if method == "spearman" else x.corr(y)
        if np.isnan(want):
            assert r is None
        else:
            assert r == pytest.approx(want, abs=1e-9)


def test_kendall_with_several_digits(spark, monkeypatch):
    """Enough digits that pairs differ first in each of them."""
    monkeypatch.setattr(correlation_module, "DIGIT_BITS", 2)
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(size=900).round(2), "b": rng.integers(0, 200, 900).astype(float)})
    pdf["c"] = pdf["a"] + rng.normal(size=900) * 0.2
    pdf.loc[:250, "a"] = 0.5
    got = pair_coefficients(spark.createDataFrame(pdf), ["a", "b", "c"], "kendall")
    for (i, j), r in got.items():
        assert r == pytest.approx(tau_b(pdf.iloc[:, i].to_numpy(), pdf.iloc[:, j].to_numpy()), abs=1e-9)


@pytest.mark.parametrize("small", [True, False])
def test_row_shuffles_do_not_grow_with_columns(spark, tied, small, monkeypatch):
    """No exchange of rows with a small index; else as many for two columns as for five."""
    monkeypatch.setattr(ranks, "BROADCAST_BYTES", [1 << 30 if small else 0])
    counts = []
    for names in (["a", "c"], ["a", "b", "c", "d", "k"]):
        numbers = correlation_module._numbers(spark.createDataFrame(tied), names)
        cells = ranks.cells_of(numbers, len(names), "1L as m")
        index = ranks.materialise(ranks.rank_index(ranks.distinct_values(cells, ["m"]), ["m"]))
        plan = ranks.ranked_rows(numbers, len(names), index, "m", ["dense"])._jdf.queryExecution().executedPlan().toString()
        counts.append(plan.count("Exchange hashpartitioning"))
    assert counts[0] == counts[1] and (counts[0] == 0) == small


def test_rank_index(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HEAVY_SHARE", 0.2)
    rng = np.random.default_rng(3)
    cells = [(r, p, float(v)) for r in range(400) for p, v in enumerate((rng.integers(0, 4), round(rng.normal(), 1), 7.0))]
    df = spark.createDataFrame(cells, "row long, pos int, value double").withColumn("w", F.lit(1).cast("long")).repartition(5)
    index = ranks.rank_index(ranks.distinct_values(df, ["w"]), ["w"])
    want = {}
    for p in range(3):
        own = sorted(v for _, q, v in cells if q == p)
        for dense, v in enumerate(sorted(set(own))):
            want[p, v] = (own.count(v), own.index(v), dense)
    assert {(r["pos"], r["value"]): (r["w"], r["w_below"], r["dense"]) for r in index.collect()} == want
    met = ranks.ranked_cells(df.select("row", "pos", "value"), index, "w").collect()
    assert len(met) == len(cells) and all((r["w"], r["w_below"], r["dense"]) == want[r["pos"], r["value"]] for r in met)


def test_concordant_kernel():
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, 9, 60), rng.integers(0, 9, 60), rng.integers(1, 4, 60)
    want = sum(w[i] * w[j] for i in range(60) for j in range(60) if x[i] < x[j] and y[i] < y[j])
    assert count_concordant(x, y, w) == want


def test_correlation_requests(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1, 2, 3, 4, 5], "b": [2, 4, 6, 8, 10], "c": [5, 4, 3, 2, 1], "t": list("abcde")}))
    assert {(r[0], r[1], r[2]) for r in strong_pairs(df).collect()} == {("a", "b", 1.0), ("a", "c", -1.0), ("b", "c", -1.0)}
    assert correlation(df, ["a", "b"]).count() == 4
    for columns in (["a"], ["a", "t"], ["a", "nope"]):
        with pytest.raises(ValidationError):
            correlation(df, columns)
    with pytest.raises(ValidationError):
        correlation(df, ["a", "b"], "cosine")


def test_iqr(spark):
    df = spark.createDataFrame(pd.DataFrame({"n": [10, 11, 12, 11, 10, 12, 11, 10, 9999], "label": list("abcdefghi")}))
    assert tuple(outlier_summary(df).first()) == ("n", "iqr", 1, 11.1111)
    worst = outlier_rows(df).collect()
    assert [(r["n"], r["label"], r["rank"]) for r in worst] == [(9999, "i", 1)]
    assert flag_outliers(df, "n").where("is_outlier").count() == 1


def test_zscore_and_edges(spark):
    df = spark.createDataFrame(pd.DataFrame({"n": [10, 11, 12] * 10 + [500], "same": [1] * 31, "gone": [None] * 31}).astype({"gone": "float64"}))
    got = {r["column"]: r["outlier_count"] for r in outlier_summary(df, method="zscore").collect()}
    assert got == {"n": 1, "same": 0, "gone": 0}
    assert outlier_rows(df, ["same"]).count() == 0
    with pytest.raises(ValidationError):
        outlier_summary(df, method="mad")
    with pytest.raises(ValidationError):
        outlier_summary(df, ["label"])
