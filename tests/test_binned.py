"""Trees grown from binned rows, against MLlib's on the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from columnscope.operators.learning import binned, supervised, train


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=4000), rng.integers(0, 12, 4000), rng.choice(["u", "v", "w"], 4000)
    y = 4 * a + b + np.where(c == "u", 6, 0) + rng.normal(size=4000)
    frame = pd.DataFrame({"a": a, "b": b.astype(float), "c": c, "y": y, "k": np.where(y + rng.normal(size=4000) > 8, "high", "low")})
    return spark.createDataFrame(frame).repartition(3).cache()


FEATURES = ["a", "b", "c"]


def both(monkeypatch, run):
    """By MLlib, and by cells."""
    monkeypatch.setattr(supervised, "TREES", 20)
    found = [run()]
    monkeypatch.setattr(binned, "DIRECT_ROWS", 0)
    made, real = [], binned.fit
    monkeypatch.setattr(binned, "fit", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    found.append(run())
    assert isinstance(made[0], binned.BinnedTrees)
    return found


def test_boosting_is_mllibs(rows, monkeypatch):
    monkeypatch.setattr(supervised, "ROUNDS", 15)
    near = rows.selectExpr("round(a, 1) as b0", "b", "c", "y").where("abs(b0) < 1.5")
    ours = both(monkeypatch, lambda: train(near, "regression", ["b0", "b", "c"], "y", "gradient_boosting"))
    assert ours[0].metrics == pytest.approx(ours[1].metrics, abs=2e-4)
    assert [i["feature"] for i in ours[0].importance] == [i["feature"] for i in ours[1].importance]
    assert [i["importance"] for i in ours[0].importance] == pytest.approx([i["importance"] for i in ours[1].importance], abs=1e-3)


def test_forest_of_numbers(rows, monkeypatch):
    mllib, cells = both(monkeypatch, lambda: train(rows, "regression", FEATURES, "y", "random_forest", tree_depth=6))
    assert cells.metrics["r2"] == pytest.approx(mllib.metrics["r2"], abs=0.02) and cells.metrics["r2"] > 0.85
    assert cells.importance[0]["feature"] == "a" and cells.test_rows == mllib.test_rows
    assert cells.importance[0]["importance"] == pytest.approx(mllib.importance[0]["importance"], abs=0.05)


def test_forest_of_classes(rows, monkeypatch):
    mllib, cells = both(monkeypatch, lambda: train(rows, "classification", FEATURES, "k", "random_forest", tree_depth=6))
    for metric in ("accuracy", "f1", "roc_auc"):
        assert cells.metrics[metric] == pytest.approx(mllib.metrics[metric], abs=0.03)
    assert sum(n for *_, n in cells.confusion) == cells.test_rows


def test_layout_does_not_matter(rows, monkeypatch):
    monkeypatch.setattr(supervised, "TREES", 5)
    monkeypatch.setattr(binned, "DIRECT_ROWS", 0)
    # a sample of all rows, so that the ranges are the same as well
    runs = [train(r, "regression", FEATURES, "y", "random_forest", tree_depth=4).metrics for r in (rows, rows.repartition(7))]
    assert runs[0] == runs[1]


def test_many_labels_of_one_cell_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(binned, "BLOCK", 100)
    groups = spark.range(5000).selectExpr("7L as code", "double(id) as label", "if(id % 2 = 0, 1L, 3L) as n")
    drawn = binned._drawn(groups, 5000, 40, 1, False)
    got = drawn.groupBy("tree").agg({"w": "sum", "y": "sum", "*": "count"}).toPandas()
    assert len(got) == 40 and got["count(1)"].min() > 40
    # Poisson sums: 10,000 with a deviation of 100
    assert abs(got["sum(w)"].mean() - 10_000) < 100 and 50 < got["sum(w)"].std() < 200
    assert abs(got["sum(y)"].mean() / 10_000 - 2500) < 30


def test_left_to_mllib(rows, monkeypatch):
    assert binned.fit(None, 10, 1, trees=5, depth=2) is None
    wide = binned.Cells([np.arange(31.0)] * 13)
    assert not wide.fits and binned.Cells([np.arange(31.0)] * 12).fits
    cells = binned.Cells([np.array([0.5]), np.array([1.0, 2.0])])
    points = np.array([[0.5, 2.0], [0.6, 2.1], [0.0, 1.0]])
    assert cells.bins(cells.codes(points)).tolist() == [[0, 1], [1, 2], [0, 0]]
