"""What training returns: small record lists with DataFrame views, and the fitted model."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Trained:
    spark: SparkSession
    task: str
    algorithm: str
    features: list[str]
    target: str | None = None
    metrics: dict[str, float | None] = field(default_factory=dict)
    importance: list[dict[str, Any]] = field(default_factory=list)
    confusion: list[tuple[str, str, int]] = field(default_factory=list)
    train_rows: int | None = None
    test_rows: int | None = None
    rows_used: int | None = None
    cluster_sizes: dict[int, int] = field(default_factory=dict)
    centroids: list[list[float]] = field(default_factory=list)
    sample_rows: DataFrame | None = None
    scored: DataFrame | None = None
    model: PipelineModel | None = None

    def metrics_frame(self) -> DataFrame:
        rows = [(self.task, self.algorithm, k, None if v is None else float(v)) for k, v in self.metrics.items()]
        return self.spark.createDataFrame(rows, "task string, algorithm string, metric string, value double")

    def importance_frame(self) -> DataFrame:
        rows = [(i["feature"], i["importance"], i["importance_pct"]) for i in self.importance]
        return self.spark.createDataFrame(rows, "feature string, importance double, importance_pct double")

    def confusion_frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.confusion, "actual string, predicted string, count long")

    def clusters_frame(self) -> DataFrame:
        rows = [
            (k, n, [float(c) for c in self.centroids[k]]) for k, n in sorted(self.cluster_sizes.items())
        ]
        return self.spark.createDataFrame(rows, "cluster int, size long, centroid array<double>")
