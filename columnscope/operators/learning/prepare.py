"""Feature typing, preprocessing stages and feature names."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import FeatureHasher, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import as_number, is_numeric, ref, require_columns, type_of
from columnscope.operators.counting import rendered

MIN_ROWS = 10
MAX_IMPORTANCES = 15
# One-hot labels are kept on the driver; a text feature with more values needs a higher ``max_one_hot`` or encoding="hashed" (a fixed width).
ENCODINGS = ("one_hot", "hashed")
MAX_ONE_HOT = 10_000
HASH_WIDTH = 1 << 18


def split_types(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """(numeric including booleans, everything else)."""
    numeric = [f for f in features if is_numeric(type_of(df, f), include_bool=True)]
    return numeric, [f for f in features if f not in numeric]


def check_features(df: DataFrame, features: list[str], target: str | None = None) -> None:
    """Refuse an empty list, names the table lacks, and a target among its own inputs."""
    if target is not None:
        require_columns(df, [target], "target")
    if not features:
        raise ValidationError("At least one feature column is needed.")
    known = set(df.columns)
    if unknown := sorted(set(features) - known):
        raise ValidationError(f"The table has no feature column(s) {', '.join(unknown)}.")
    if target in features:
        raise ValidationError(f"{target!r} cannot be both target and feature.")


def feature_table(df: DataFrame, features: list[str], extra: list[str] = ()) -> DataFrame:
    """Doubles named ``n0..`` and texts named ``t0..``, plus ``extra`` columns unchanged."""
    numeric, texts = split_types(df, features)
    return df.select(
        *[as_number(df, n).alias(f"n{i}") for i, n in enumerate(numeric)],
        *[rendered(df, t).alias(f"t{i}") for i, t in enumerate(texts)],
        *[ref(e) for e in extra],
    )


class Preparation:
    """Mean-impute and standardise numbers; fill texts with their mode and encode them as ``encoding`` says."""

    def __init__(self, numeric: list[str], texts: list[str], encoding: str = "one_hot", max_one_hot: int = MAX_ONE_HOT) -> None:
        if encoding not in ENCODINGS:
            raise ValidationError(f"No encoding is called {encoding!r}; there are {', '.join(ENCODINGS)}.")
        self.numeric, self.texts, self.encoding, self.max_one_hot = numeric, texts, encoding, max_one_hot
        self.modes: dict[str, str] = {}
        self.hashed: list[str] = []

    def _filled(self, table: DataFrame) -> DataFrame:
        return table.fillna(self.modes) if self.modes else table

    def fit(self, train: DataFrame) -> tuple[list[Transformer], DataFrame]:
        """Fitted stages and the prepared training table (with column ``features``)."""
        texts = [f"t{i}" for i in range(len(self.texts))]
        if texts:
            row = train.agg(*[F.mode(t, True).alias(t) for t in texts]).first()
            self.modes = {t: row[t] for t in texts if row[t] is not None}
        if texts and self.encoding == "one_hot":
            self._check_width(train, texts)
        self.hashed = texts if self.encoding == "hashed" else []
        indexed = [t for t in texts if t not in self.hashed]
        numbers = [f"n{i}" for i in range(len(self.numeric))]
        stages: list = []
        parts: list[str] = []
        if numbers:
            stages += [
                Imputer(strategy="mean", inputCols=numbers, outputCols=[f"{n}_full" for n in numbers]),
                VectorAssembler(inputCols=[f"{n}_full" for n in numbers], outputCol="numbers"),
                StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
            ]
            parts.append("scaled")
        if indexed:
            stages += [
                StringIndexer(
                    inputCols=indexed, outputCols=[f"{t}_id" for t in indexed],
                    handleInvalid="keep", stringOrderType="alphabetAsc",
                ),
                # The last slot is the one for values never seen in training: dropping it makes them all zeros.
                OneHotEncoder(
                    inputCols=[f"{t}_id" for t in indexed], outputCols=[f"{t}_hot" for t in indexed],
                    dropLast=True, handleInvalid="error",
                ),
            ]
            parts += [f"{t}_hot" for t in indexed]
        if self.hashed:
            stages.append(FeatureHasher(inputCols=self.hashed, outputCol="hashed", numFeatures=HASH_WIDTH))
            parts.append("hashed")
        stages.append(VectorAssembler(inputCols=parts, outputCol="features"))

        table, fitted = self._filled(train), []
        for stage in stages:
            model = stage.fit(table) if hasattr(stage, "fit") else stage
            table = model.transform(table)
            fitted.append(model)
        self.model = PipelineModel(fitted)
        self.names = self._feature_names(fitted, numbers, indexed)
        return fitted, table

    def _check_width(self, train: DataFrame, texts: list[str]) -> None:
        row = train.agg(*[F.count_distinct(t).alias(t) for t in texts]).first()
        wide = [self.texts[i] for i, t in enumerate(texts) if row[t] > self.max_one_hot]
        if wide:
            raise ValidationError(f"Feature(s) {wide} have more than {self.max_one_hot} values; raise max_one_hot or use encoding='hashed'.")

    def transform(self, table: DataFrame) -> DataFrame:
        return self.model.transform(self._filled(table))

    def _feature_names(self, fitted: list, numbers: list[str], indexed: list[str]) -> list[str]:
        names = list(self.numeric)
        indexer = next((s for s in fitted if hasattr(s, "labelsArray")), None)
        if indexer is not None:
            for t, labels in zip(indexed, indexer.labelsArray):
                source = self.texts[int(re.sub(r"\D", "", t))]
                names += [f"{source}_{label}" for label in labels]
        if self.hashed:
            names += [f"hashed_{i}" for i in range(HASH_WIDTH)]
        return names


def feature_importance(names: list[str], weights: list[float]) -> list[dict]:
    """The largest weights with their share of all weights; none where a model reports another number of weights."""
    if len(names) != len(weights) or not names:
        return []
    values = np.asarray(weights, float)
    share = 100 * values / (values.sum() or 1.0)
    first = np.argsort(-values, kind="stable")[:MAX_IMPORTANCES]
    return [dict(feature=names[i], importance=round(values[i].item(), 4), importance_pct=round(share[i].item(), 2)) for i in first]
