"""Isolation Forest: bounded per-tree samples, trees grown in parallel tasks, rows scored in Arrow batches.

What is shuffled to the tree builders is bounded by the forest's parameters, not by the table: about twice
``TREES * SAMPLE`` rows; the finished forest has under ``2 * TREES * SAMPLE`` nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import as_number, ref
from columnscope.functions.quantiles import grouped_quantiles
from columnscope.functions.sizing import materialise, spread
from columnscope.operators.learning.clustering import numeric_features
from columnscope.operators.learning.prepare import MIN_ROWS
from columnscope.operators.learning.result import Trained
from columnscope.operators.query import row_order

TREES = 100
SAMPLE = 256
SAMPLE_ROWS = 20
SCORED_AT_ONCE = 4096
_NODE_SCHEMA = "tree int, node int, feature int, cut double, lower int, upper int, depth double"


def mean_depth(n: float) -> float:
    """Average depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes ``(node, feature, cut, lower, upper, depth)``; a leaf has feature -1 and its adjusted depth."""
    nodes: list[tuple] = [()]
    todo = [(0, points, 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(usable):
            nodes[at] = (at, -1, 0.0, -1, -1, depth + mean_depth(len(rows)))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = rows[:, feature] <= cut
        first = len(nodes)
        nodes += [(), ()]
        nodes[at] = (at, feature, cut, first, first + 1, 0.0)
        todo += [(first, rows[below], depth + 1), (first + 1, rows[~below], depth + 1)]
    return nodes


# Copies of a row are numbered in blocks of so many, which are dealt over the tasks.
COPY_BLOCK = 4096


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``, a number from 1 on among equal ones; no task or array has to hold all copies of a row."""
    columns = [ref(c) for c in rows.columns]
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    block = F.lit(COPY_BLOCK).cast("long")
    few = counted.where(F.col("copies") <= block).withColumn("from", F.lit(1).cast("long"))
    many = counted.where(F.col("copies") > block).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), block)))
    pieces = few.unionByName(many.repartition(*columns, "from"))
    return pieces.select(*columns, F.explode(F.sequence(F.col("from"), F.least(F.col("copies"), F.col("from") + block - 1))).alias("copy"))


def _sample(rows: DataFrame, total: int, seed: int) -> DataFrame:
    """``tree, key`` and the features of rows that may belong to a tree's sample, by one rule at every size.

    A tree's sample has the ``min(SAMPLE, total)`` rows with the lowest keys; a key is a hash of the tree, the values and
    the number of the copy among equal rows, so it depends neither on partitions nor on row order. Only keys
    below a bound go on, which twice the sample is expected to meet: fewer than the sample is out of all likelihood.
    """
    columns = [ref(c) for c in rows.columns]
    share = min(1.0, (2 * SAMPLE + 64) / total)
    bound = min(int((2 * share - 1) * 2 ** 63), 2 ** 63 - 1)
    copy = F.col("copy")
    # a number that fits is hashed as an int
    h = F.when(copy <= 2 ** 31 - 1, F.xxhash64(F.lit(seed), *columns, copy.cast("int"))).otherwise(F.xxhash64(F.lit(seed), *columns, copy))
    keyed = _numbered(rows).withColumn("h", h)
    # one generated row for each tree is compiled with the filter; a function over an array of trees is not
    key = F.expr("xxhash64(h, tree)")
    drawn = keyed.select(F.explode(F.expr(f"sequence(0, {TREES - 1})")).alias("tree"), "h", *columns).where(key <= F.lit(bound).cast("long"))
    return drawn.select("tree", key.alias("key"), *columns)


def fit_forest(rows: DataFrame, total: int, seed: int) -> pd.DataFrame:
    width = len(rows.columns)
    columns = list(rows.columns)
    size = min(SAMPLE, total)
    depth = math.ceil(math.log2(max(size, 2)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        points = pdf.sort_values(["key", *columns])[columns].to_numpy(dtype="float64").reshape(-1, width)[:size]
        nodes = grow_tree(points, rng, depth)
        frame = pd.DataFrame(nodes, columns=["node", "feature", "cut", "lower", "upper", "depth"])
        frame.insert(0, "tree", tree)
        return frame

    return _sample(rows, total, seed).groupBy("tree").applyInPandas(build, _NODE_SCHEMA).toPandas()


def _scorer(forest: pd.DataFrame, normal: float):
    trees = []
    for _, t in forest.sort_values(["tree", "node"]).groupby("tree"):
        feature, cut, lower, depth = (t[c].to_numpy() for c in ("feature", "cut", "lower", "depth"))
        inner = feature >= 0
        here = np.arange(len(t))
        # the upper child follows the lower one; a leaf leads to itself, whatever the row
        level = np.zeros(len(t), np.int64)
        for node in here[inner]:
            level[lower[node]] = level[lower[node] + 1] = level[node] + 1
        trees.append((np.where(inner, feature, 0).astype(np.intp), np.where(inner, cut, np.inf), np.where(inner, lower, here).astype(np.intp), depth, int(level.max())))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            # one feature arrives by itself, several as a tuple
            columns = batch if isinstance(batch, tuple) else (batch,)
            values = [s.to_numpy(dtype="float64") for s in columns]
            width = len(values)
            points, depths = np.column_stack(values).ravel(), np.zeros(len(values[0]))
            # few enough rows at once that all arrays stay in a core's cache
            for first in range(0, len(depths), SCORED_AT_ONCE):
                own = depths[first:first + SCORED_AT_ONCE]
                start = np.arange(first, first + len(own), dtype=np.intp) * width
                for feature, cut, lower, depth, deepest in trees:
                    at = np.zeros(len(own), dtype=np.intp)
                    for _ in range(deepest):
                        place = feature.take(at, mode="clip")
                        place += start
                        above = points.take(place, mode="clip") > cut.take(at, mode="clip")
                        at = lower.take(at, mode="clip")
                        at += above
                    own += depth.take(at, mode="clip")
            yield pd.Series(-np.power(2.0, -depths / len(trees) / normal))

    return score


def detect_anomalies(df: DataFrame, features: list[str], contamination: float = 0.05, seed: int = 42) -> Trained:
    """Share ``contamination`` of the rows with the lowest scores, and the 20 most anomalous full rows."""
    if not 0 < contamination <= 0.5:
        raise ValidationError("The share of anomalies lies above 0 and reaches 0.5 at most.")
    rows = numeric_features(df, features, "Anomaly detection")
    total = rows.count()
    if total < MIN_ROWS:
        raise ValidationError(f"Finding anomalies takes {MIN_ROWS} complete rows or more; there are {total}.")
    forest = fit_forest(rows, total, seed)
    normal = mean_depth(min(SAMPLE, total)) or 1.0
    score = _scorer(forest, normal)

    numbers = [as_number(df, f) for f in features]
    complete = df
    for number in numbers:
        complete = complete.where(number.isNotNull())
    scored = complete.withColumn("anomaly_score", score(*numbers))
    # Eight bytes a row: Python scores each row once here, whatever is computed from the scores.
    scores = materialise(spread(rows).select(score(*rows.columns).alias("anomaly_score")))
    limit = grouped_quantiles(scores, [], ["anomaly_score"], [contamination]).first()["anomaly_score"][0]
    found = scores.where(F.col("anomaly_score") < limit).count()
    worst = scored.where(F.col("anomaly_score") < limit).orderBy("anomaly_score", *row_order(df)).limit(SAMPLE_ROWS)
    return Trained(
        df.sparkSession, "anomaly_detection", "isolation_forest", features,
        metrics={"anomaly_count": found, "anomaly_percentage": round(100 * found / total, 4)},
        rows_used=total, sample_rows=worst,
        scored=scored.withColumn("is_anomaly", F.col("anomaly_score") < limit),
    )
