from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.operators.learning import anomaly, clustering, train
from columnscope.operators.learning.split import allocate, test_quota as quota_for
from columnscope.operators.learning.supervised import classification_metrics, stratified_split


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    score = rng.normal(size=100)
    pdf = pd.DataFrame({
        "score": score, "label": np.where(score > 0, "pos", "neg"), "category": rng.choice(["A", "B"], 100),
        "y": 3 * score + rng.normal(size=100) * 0.05, "noise": rng.normal(size=100),
    })
    pdf.loc[:3, "score"] = np.nan
    pdf.loc[4:6, "category"] = None
    return spark.createDataFrame(pdf)


def test_classification(labelled):
    got = train(labelled, "classification", ["score", "category"], "label")
    assert got.metrics["accuracy"] > 0.8 and got.metrics["roc_auc"] > 0.8
    assert (got.train_rows, got.test_rows) == (80, 20)  # rows with missing features are kept
    assert sum(n for *_, n in got.confusion) == 20 and len(got.confusion) == 4
    assert [i["feature"] for i in got.importance][0] == "score"
    assert {i["feature"] for i in got.importance} == {"score", "category_A", "category_B"}


def test_forest_classifier(labelled):
    assert train(labelled, "classification", ["score", "noise"], "label", "random_forest").metrics["accuracy"] > 0.8


def test_regression(labelled):
    got = train(labelled, "regression", ["score", "category"], "y")
    assert got.metrics["r2"] > 0.8 and got.importance[0]["feature"] == "score"
    assert got.metrics["rmse"] == pytest.approx(got.metrics["mse"] ** 0.5, abs=1e-3)


@pytest.mark.parametrize("task, request_", [
    ("classification", dict(features=["score"], target="nope")), ("classification", dict(features=["nope"], target="label")),
    ("classification", dict(features=["label"], target="label")), ("classification", dict(features=["score"], target="label", algorithm="svm")),
    ("regression", dict(features=["score"], target="label")), ("regression", dict(features=["score"], target="y", algorithm="svm")),
    ("clustering", dict(features=["category"])), ("clustering", dict(features=["noise"], n_clusters=1)),
    ("clustering", dict(features=["noise"], n_clusters=40)), ("anomaly_detection", dict(features=["label"])),
    ("anomaly_detection", dict(features=["noise"], contamination=0.9)), ("ranking", dict(features=["noise"])),
    ("regression", dict(features=["noise"])),
])
def test_refusals(labelled, task, request_):
    with pytest.raises(ValidationError):
        train(labelled, task, **request_)


def test_too_little_data(spark):
    small = spark.createDataFrame(pd.DataFrame({"x": range(5), "y": list("ababa")}))
    lone = spark.createDataFrame(pd.DataFrame({"x": range(20), "y": ["a"] * 19 + ["b"]}))
    for df in (small, lone, lone.withColumn("y", lone["x"] * 0)):
        with pytest.raises(ValidationError):
            train(df, "classification", ["x"], "y")


def silhouette(points, labels, squared=False):
    away = np.sqrt(((points[:, None] - points[None, :]) ** 2).sum(2))
    away = away ** 2 if squared else away
    out = []
    for i, own in enumerate(labels):
        nearest = min(away[i, labels == c].mean() for c in set(labels) if c != own)
        inside = away[i, labels == own].sum() / max((labels == own).sum() - 1, 1)
        out.append((nearest - inside) / max(inside, nearest) if (labels == own).sum() > 1 else 0)
    return np.mean(out)


def test_clustering(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(40, 2)), rng.normal(size=(25, 2)) + 9, rng.normal(size=(15, 2)) * 0.5 + [9, -9]])
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b"])).repartition(4)
    got = train(df, "clustering", ["a", "b"], n_clusters=3)
    assert sorted(got.cluster_sizes.values()) == [15, 25, 40]
    want = [points[:40].mean(0), points[65:].mean(0), points[40:65].mean(0)]
    assert np.allclose(sorted(got.centroids), sorted(w.tolist() for w in want), atol=1e-6)
    labels = np.repeat([0, 1, 2], [40, 25, 15])
    scaled = (points - points.mean(0)) / points.std(0)
    assert got.metrics["silhouette_score"] == pytest.approx(silhouette(scaled, labels), abs=1e-4)
    squared = clustering.train_clustering(df, ["a", "b"], 3, silhouette="squared")
    assert squared.metrics["silhouette_score"] == pytest.approx(silhouette(scaled, labels, True), abs=1e-4)
    named = got.model.transform(spark.createDataFrame(pd.DataFrame(points, columns=["f0", "f1"]))).toPandas()["prediction"].to_numpy()
    assert len(set(zip(named, labels))) == 3
    with pytest.raises(ValidationError):
        clustering.train_clustering(df, ["a", "b"], 3, silhouette="cosine")


def test_all_starts_share_their_passes(spark, monkeypatch):
    """As many jobs over the rows as the slowest start takes passes, not the sum over starts."""
    passes = []
    real = clustering._pass

    def noted(rows, mean, scale, centres):
        passes.append(len(centres))
        return real(rows, mean, scale, centres)

    monkeypatch.setattr(clustering, "_pass", noted)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=500), "c": 1.0}))
    got = train(df, "clustering", ["a", "c"], n_clusters=4)
    assert passes[0] == passes[-1] == clustering.STARTS and sorted(passes[:-1], reverse=True) == passes[:-1]
    assert sum(got.cluster_sizes.values()) == 500 and all(c[1] == 1.0 for c in got.centroids)
    same = train(spark.createDataFrame([(1.0,)] * 12, "a double"), "clustering", ["a"], n_clusters=2)
    assert sum(same.cluster_sizes.values()) == 12 and same.metrics["silhouette_score"] is None


def test_anomalies(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(95, 2)), rng.normal(size=(5, 2)) * 0.5 + 12])
    got = train(spark.createDataFrame(pd.DataFrame(points, columns=["a", "b"])), "anomaly_detection", ["a", "b"])
    assert got.metrics == {"anomaly_count": 5, "anomaly_percentage": 5.0}
    assert all(r["a"] > 8 for r in got.sample_rows.collect())


def test_anomalies_of_one_feature(spark):
    got = train(spark.createDataFrame([(float(i % 10),) for i in range(95)] + [(500.0 + i,) for i in range(5)], "a double"), "anomaly_detection", ["a"])
    assert got.metrics["anomaly_count"] <= 5 and all(r["a"] >= 500 for r in got.sample_rows.collect())


def test_split_is_exact(spark):
    assert allocate([3, 3, 4], 5) == [2, 1, 2] and quota_for({"a": 50, "b": 50}, 0.2) == {"a": 10, "b": 10}
    df = spark.createDataFrame(pd.DataFrame({"t": ["a"] * 900 + ["b"] * 101, "x": range(1001)}))
    train_rows, test_rows = stratified_split(df, "t", ["x"])
    assert {r["t"]: r["count"] for r in test_rows.groupBy("t").count().collect()} == {"a": 181, "b": 20}
    assert sorted(r["x"] for r in train_rows.union(test_rows).collect()) == list(range(1001))
    # Copies of one row cannot be told apart by a hash; the counts must still be exact.
    copies = spark.createDataFrame(pd.DataFrame({"t": ["a"] * 900 + ["b"] * 101, "x": [1] * 1001}))
    train_rows, test_rows = stratified_split(copies, "t", ["x"])
    assert (train_rows.count(), test_rows.count()) == (800, 201)
    # The same rows are chosen however the table is laid out.
    again = stratified_split(df.repartition(5), "t", ["x"])[1]
    assert {r["x"] for r in again.collect()} == {r["x"] for r in stratified_split(df, "t", ["x"])[1].collect()}


def test_metrics_from_confusion():
    got = classification_metrics({(0, 0): 8, (0, 1): 2, (1, 0): 1, (1, 1): 9}, 2)
    assert got == {"accuracy": 0.85, "precision": 0.8535, "recall": 0.85, "f1": 0.8496}


def test_copies_of_one_row_are_dealt_over_tasks(spark):
    rows = spark.range(60_000).select(F.lit(1.5).alias("x"), F.lit(2).alias("copies")).unionAll(spark.range(10).select(F.col("id") + 0.25, F.lit(3)))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        drawn = anomaly._sample(rows.withColumnRenamed("copies", "y"), 60_010, 7).where("x = 1.5").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(key, before)
    assert drawn > 1


def test_passes_read_packed_rows(spark):
    """A pass gets a value for thousands of rows; equally near centres give a row to the first, as argmin does."""
    points = np.array([[0.0, 0], [1, 0], [2, 0], [3, 0]] * 2500)
    rows = spark.createDataFrame(pd.DataFrame(points, columns=["f0", "f1"])).repartition(2)
    blocks = clustering._packed(rows)
    assert blocks.count() <= 4
    centres = {0: np.array([[0.0, 0], [2, 0]]), 7: np.array([[3.0, 0], [3, 0]])}
    found = clustering._pass(blocks, np.zeros(2), np.ones(2), centres)
    assert found[0][0].tolist() == [5000, 5000] and found[0][1][:, 0].tolist() == [2500, 12500] and found[0][2] == 5000
    assert found[7][0].tolist() == [10000, 0] and found[7][2] == 2500 * 14


def test_scores_are_those_of_a_walk(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(5000, 2)).round(1)
    frames, walked = [], np.zeros(5000)
    for tree in range(5):
        nodes = anomaly.grow_tree(points[rng.integers(0, 5000, 64)], rng, 6)
        frames.append(pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "cut", "lower", "upper", "depth"]))
        for i, p in enumerate(points):
            at = 0
            while nodes[at][1] >= 0:
                at = nodes[at][3] if p[nodes[at][1]] <= nodes[at][2] else nodes[at][4]
            walked[i] += nodes[at][5]
    score = anomaly._scorer(pd.concat(frames), 3.0)
    df = spark.createDataFrame(pd.DataFrame(np.c_[points, np.arange(5000)], columns=["a", "b", "i"]))
    got = df.select("i", score("a", "b").alias("s")).orderBy("i").toPandas()["s"].to_numpy()
    assert np.allclose(got, -np.power(2.0, -walked / 5 / 3.0), rtol=1e-15)
