from __future__ import annotations

import numpy as np
import pandas as pd

from columnscope.operators.asof import asof_join


def test_against_pandas(spark):
    """A hot key, a hot instant, missing times and keys, left rows before every right row."""
    rng = np.random.default_rng(4)
    n = 1500
    left = pd.DataFrame({"k": rng.choice(["hot", "b", "c"], n, p=[0.7, 0.2, 0.1]), "t": rng.uniform(0, 100, n).round(1), "id": range(n)})
    left.loc[:400, "t"] = 40.0
    right = pd.DataFrame({"k": rng.choice(["hot", "b"], 600, p=[0.8, 0.2]), "t": rng.permutation(6000)[:600] / 50 + 5, "v": rng.normal(size=600)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k").set_index("id")["v"]
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "t", "t", ["k"], ["v"]).collect()
    assert len(got) == n
    for row in got:
        expected = want[row["id"]]
        assert row["matched_v"] == expected or (row["matched_v"] is None and np.isnan(expected))


def test_missing_times_and_keys_match_nothing(spark):
    left = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), (None, 5.0, 3), ("a", 9.0, 4)], "k string, t double, id int")
    right = spark.createDataFrame([("a", 2.0, 7), (None, 1.0, 8), ("a", None, 9)], "k string, u double, v int")
    got = {r["id"]: r["matched_v"] for r in asof_join(left, right, "t", "u", ["k"], ["v"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 7}
