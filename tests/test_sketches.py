"""Mergeable states against the exact statistics, and profiles that read new files only."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from columnscope.errors import ValidationError
from columnscope.operators.sketches import approximate_profile, column_states, distinct_error, estimates, merged, rank_error
from columnscope.sources.increments import profile_of_files


@pytest.fixture(scope="module")
def readings():
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"level": rng.gamma(2.0, 50.0, 30_000), "code": rng.integers(0, 9_000, 30_000), "tag": [f"t{v}" for v in rng.integers(0, 5_000, 30_000)], "none": np.nan})
    pdf.loc[::7, "level"] = np.nan
    return pdf


def agrees(row, column):
    filled = column.dropna()
    assert (row["rows"], row["missing"]) == (len(column), len(column) - len(filled))
    assert abs(row["distinct"] - filled.nunique()) <= 3 * row["distinct_error"] * filled.nunique()
    if filled.dtype.kind in "if" and len(filled):
        assert row["count"] == len(filled) and row["min"] == filled.min() and row["max"] == filled.max()
        assert row["mean"] == pytest.approx(filled.mean()) and row["std"] == pytest.approx(filled.std())
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert abs((filled <= row[name]).mean() - q) <= row["rank_error"] + 1e-3
    else:
        assert row["mean"] is None and row["median"] is None


def test_parts_make_the_whole(spark, readings):
    df = spark.createDataFrame(readings).selectExpr("*", "pmod(hash(code), 6) as part")
    parts = merged(column_states(df, by=["part"]))
    for rows in (approximate_profile(df.drop("part")), estimates(parts)):
        found = {r["name"]: r for r in rows.collect()}
        assert list(found) and set(found) == set(readings.columns)
        for name in readings.columns:
            agrees(found[name], readings[name])
    assert distinct_error(12) == pytest.approx(0.01625) and 0.013 < rank_error(200) < 0.014


def test_only_new_files_are_read(spark, readings, tmp_path):
    folder, store = str(tmp_path / "table"), str(tmp_path / "states")

    def add(rows, mode="append"):
        spark.createDataFrame(rows).coalesce(1).write.mode(mode).parquet(folder)

    def looked():
        rows, read = profile_of_files(spark, folder, store)
        return {r["name"]: r for r in rows.collect()}, read

    add(readings[:8_000])
    add(readings[8_000:12_000])
    found, read = looked()
    assert read == 2
    agrees(found["code"], readings["code"][:12_000])
    add(readings[12_000:])
    found, read = looked()
    assert read == 1
    for name in ("level", "code", "tag"):
        agrees(found[name], readings[name])
    assert looked()[1] == 0
    add(readings[:500], "overwrite")
    found, read = looked()
    assert read == 1 and found["level"]["rows"] == 500
    with pytest.raises(ValidationError):
        (tmp_path / "empty").mkdir()
        profile_of_files(spark, str(tmp_path / "empty"), str(tmp_path / "other"))
