"""K-Means over standardised numeric features: all starts go through the same passes over the rows.

The starts are seeded (k-means++) on one bounded sample. In every pass each task adds up, for every start at once, the rows
that are nearest to each centre, so that a pass sends one row for each start and cluster to a shuffle and as many to the
driver, whatever the table's size. A start that no longer moves is not looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import as_number, is_numeric, type_of
from columnscope.functions.sizing import kept, shared_scan
from columnscope.operators.learning.prepare import MIN_ROWS, check_features
from columnscope.operators.learning.result import Trained

MAX_CLUSTERS = 20
STARTS = 10
MAX_PASSES = 100
# A start has settled once its centres move less than this share of the features' spread (their variance is 1).
TOLERANCE = 1e-4
SEED_ROWS = 8192
SILHOUETTE_ROWS = 1024
# Rows whose distances to all centres stay in a core's cache.
ROWS_AT_ONCE = 2048
ASKED_AT_ONCE = 128
SILHOUETTES = ("euclidean", "squared")


def numeric_features(df: DataFrame, features: list[str], what: str) -> DataFrame:
    """Rows with every feature present, as doubles ``f0..``."""
    check_features(df, features)
    bad = [f for f in features if not is_numeric(type_of(df, f), include_bool=True)]
    if bad:
        raise ValidationError(f"{what} works on numbers; these features hold none: {', '.join(bad)}")
    return df.select(*[as_number(df, f).alias(f"f{i}") for i, f in enumerate(features)]).dropna()


def _sample(rows: DataFrame, total: int, most: int, seed: int) -> np.ndarray:
    """About ``most`` rows, or all if there are no more."""
    picked = rows if total <= most else rows.where(F.rand(seed) < most / total)
    found = picked.limit(2 * most).toPandas().to_numpy(float)
    return found if len(found) else rows.limit(most).toPandas().to_numpy(float)


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to centres (columns)."""
    return np.maximum((points ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2 * points @ centres.T, 0)


def seeded_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre is a sample row, drawn in proportion to its squared distance to those before."""
    centres = [sample[rng.integers(len(sample))]]
    nearest = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = nearest.sum()
        at = rng.choice(len(sample), p=nearest / total) if total > 0 else rng.integers(len(sample))
        centres.append(sample[at])
        nearest = np.minimum(nearest, ((sample - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def _packed(rows: DataFrame) -> DataFrame:
    """The rows, thousands to a value: a pass reads them as they are, without a record for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = np.column_stack([c.to_numpy() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array([points.tobytes()], pa.binary())], names=["points"])

    return rows.mapInArrow(run, "points binary")


def _matrices(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        for points in batch.column("points"):
            yield (np.frombuffer(points.as_buffer()).reshape(-1, len(mean)) - mean) / scale


def _pass(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each start: rows and sums of coordinates of each cluster, and the sum of squared distances to the nearest centre."""
    starts, width = list(centres), len(mean)
    sent = rows.sparkSession.sparkContext.broadcast(np.vstack([centres[s] for s in starts]))
    k = len(centres[starts[0]])

    def added(batches):
        middles = sent.value
        slots = len(middles)
        sizes, sums, costs = np.zeros(slots), np.zeros((slots, width)), np.zeros((len(starts), k))
        for whole in _matrices(batches, mean, scale):
            for first in range(0, len(whole), ROWS_AT_ONCE):
                points = whole[first:first + ROWS_AT_ONCE]
                # a row for each centre, so that every step below runs along memory
                away = _squared(middles, points).reshape(len(starts), k, -1)
                nearest, label = away[:, 0].copy(), np.zeros((len(starts), len(points)), np.int8)
                for c in range(1, k):
                    # the first of equally near centres
                    closer = away[:, c] < nearest
                    np.copyto(nearest, away[:, c], where=closer)
                    np.copyto(label, np.int8(c), where=closer)
                own = (label[:, None, :] == np.arange(k, dtype=np.int8)[None, :, None]).reshape(slots, -1).astype(float)
                sizes += own.sum(1)
                sums += own @ points
                # only their sum over a start is asked for
                costs[:, 0] += nearest.sum(1)
        columns = [pa.array(np.arange(slots)), pa.array(sizes), pa.array(costs.ravel()), *[pa.array(sums[:, j]) for j in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "size", "cost", *[f"s{j}" for j in range(width)]])

    schema = "slot long, size double, cost double, " + ", ".join(f"s{j} double" for j in range(width))
    totals = rows.mapInArrow(added, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("size", "cost", *[f"s{j}" for j in range(width)])])
    found = np.array(sorted(tuple(r) for r in totals.collect()))  # one row for each start and cluster
    return {s: (found[i * k:(i + 1) * k, 1], found[i * k:(i + 1) * k, 3:], float(found[i * k:(i + 1) * k, 2].sum())) for i, s in enumerate(starts)}


def _silhouette(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, centres: np.ndarray, sizes: np.ndarray, sample: np.ndarray, squared: bool) -> float:
    """Mean silhouette of the sample rows, each compared with every row of the table."""
    k = len(centres)
    sent = rows.sparkSession.sparkContext.broadcast((sample, centres))

    def added(batches):
        asked, middle = sent.value
        totals = np.zeros((len(asked), k))
        # squared distances as one product: (-2 a, |a|^2, 1) by (p, 1, |p|^2)
        left = np.column_stack([-2 * asked, (asked ** 2).sum(1), np.ones(len(asked))])
        for points in _matrices(batches, mean, scale):
            right = np.column_stack([points, np.ones(len(points)), (points ** 2).sum(1)])
            label = np.eye(k)[_squared(points, middle).argmin(1)]
            for at in range(0, len(points), ASKED_AT_ONCE):
                away = left @ right[at:at + ASKED_AT_ONCE].T
                np.maximum(away, 0, out=away)
                totals += (away if squared else np.sqrt(away, out=away)) @ label[at:at + ASKED_AT_ONCE]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(totals.size)), pa.array(totals.ravel())], names=["slot", "total"])

    found = rows.mapInArrow(added, "slot long, total double").groupBy("slot").agg(F.sum("total").alias("total")).orderBy("slot").toPandas()
    totals = found["total"].to_numpy().reshape(len(sample), k)
    own = _squared(sample, centres).argmin(1)
    here = np.arange(len(sample))
    inside = totals[here, own] / np.maximum(sizes[own] - 1, 1)
    others = totals / np.maximum(sizes, 1)
    others[here, own] = np.inf
    others[:, sizes == 0] = np.inf
    nearest = others.min(1)
    widest = np.maximum(inside, nearest)
    score = np.where((sizes[own] > 1) & (widest > 0), (nearest - inside) / np.where(widest > 0, widest, 1), 0.0)
    return float(score.mean())


def _assigner(width: int, mean: np.ndarray, scale: np.ndarray, centres: np.ndarray) -> SQLTransformer:
    """Nearest centre of columns f0.. as a stage that any table with them can go through."""
    away = [" + ".join(f"pow((f{j} - {mean[j].item()!r}d) / {scale[j].item()!r}d - {c[j].item()!r}d, 2)" for j in range(width)) for c in centres]
    distances = f"array({', '.join(away)})"
    return SQLTransformer(statement=f"SELECT *, CAST(array_position({distances}, array_min({distances})) - 1 AS INT) AS prediction FROM __THIS__")


def train_clustering(
    df: DataFrame, features: list[str], n_clusters: int = 3, seed: int = 42, *, silhouette: str = "euclidean", silhouette_rows: int = SILHOUETTE_ROWS
) -> Trained:
    """The best of ten starts. The silhouette is that of about ``silhouette_rows`` rows against all rows, which are all rows where there are
    no more, by plain or squared distances."""
    if silhouette not in SILHOUETTES:
        raise ValidationError(f"No silhouette is called {silhouette!r}; there are {', '.join(SILHOUETTES)}.")
    # a large table is scanned for its moments and samples, and kept only as the passes read it
    with shared_scan(numeric_features(df, features, "Clustering")) as rows:
        width = len(features)
        moments = [f(f"f{i}") for i in range(width) for f in (F.avg, F.stddev_pop)]
        total, *facts = rows.agg(F.count(F.lit(1)), *moments).first()
        if total < MIN_ROWS:
            raise ValidationError(f"Clustering takes {MIN_ROWS} complete rows or more; there are {total}.")
        most = min(MAX_CLUSTERS, total // 2)
        if not 2 <= n_clusters <= most:
            raise ValidationError(f"With {total} rows there can be 2 to {most} clusters, not {n_clusters}.")
        mean, scale = np.array(facts[::2]), np.array(facts[1::2])
        scale[scale == 0] = 1.0
        sample = (_sample(rows, total, SEED_ROWS, seed) - mean) / scale
        rng = np.random.default_rng(seed)
        centres = {s: seeded_centres(sample, n_clusters, rng) for s in range(STARTS)}
        with kept(_packed(rows)) as blocks:
            moving = set(centres)
            for _ in range(MAX_PASSES):
                if not moving:
                    break
                for s, (sizes, sums, _) in _pass(blocks, mean, scale, {s: centres[s] for s in sorted(moving)}).items():
                    # a cluster that has lost all rows keeps its centre
                    after = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres[s])
                    if ((after - centres[s]) ** 2).sum() <= TOLERANCE * width:
                        moving.discard(s)
                    centres[s] = after
            ended = _pass(blocks, mean, scale, centres)
            best = min(ended, key=lambda s: (ended[s][2], s))
            order = np.lexsort(centres[best].T[::-1])
            middle, sizes = centres[best][order], ended[best][0][order]
            score = None
            if (sizes > 0).sum() > 1:
                asked = (_sample(rows, total, silhouette_rows, seed + 1) - mean) / scale
                score = round(_silhouette(blocks, mean, scale, middle, sizes, asked, silhouette == "squared"), 4)
    return Trained(
        df.sparkSession, "clustering", "kmeans", features,
        metrics={"silhouette_score": score},
        cluster_sizes={i: int(n) for i, n in enumerate(sizes)},
        centroids=(middle * scale + mean).tolist(),
        rows_used=total,
        model=PipelineModel([_assigner(width, mean, scale, middle)]),
    )
