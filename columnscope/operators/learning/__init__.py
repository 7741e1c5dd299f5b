"""Model training on MLlib, with one custom model (Isolation Forest)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from columnscope.errors import ValidationError
from columnscope.operators.learning.anomaly import detect_anomalies
from columnscope.operators.learning.clustering import train_clustering
from columnscope.operators.learning.result import Trained
from columnscope.operators.learning.supervised import train_classifier, train_regressor


def train(
    df: DataFrame,
    task: str,
    features: list[str],
    target: str | None = None,
    algorithm: str | None = None,
    test_size: float = 0.2,
    n_clusters: int = 3,
    contamination: float = 0.05,
    seed: int = 42,
    **options,
) -> Trained:
    """Train the default (or named) algorithm of a task; ``options`` go to a supervised one (encoding, tree_depth, max_classes)."""
    if task in ("classification", "regression") and not target:
        raise ValidationError(f"{task!r} requires a target column.")
    if task == "classification":
        return train_classifier(df, target, features, algorithm or "logistic_regression", test_size, seed, **options)
    if task == "regression":
        return train_regressor(df, target, features, algorithm or "linear_regression", test_size, seed, **options)
    if task == "clustering":
        return train_clustering(df, features, n_clusters, seed)
    if task == "anomaly_detection":
        return detect_anomalies(df, features, contamination, seed)
    raise ValidationError(f"Unsupported task: {task!r}")
