"""Forests and boosted trees of large tables, grown from counts of binned rows.

As in MLlib, every feature is cut into at most 32 ranges by a sample, and splits lie between ranges. A tree cannot tell
rows of the same ranges (a cell) apart, so what it needs of them are sums. Each tree of a forest weighs every row by its own
Poisson draw of mean 1, as MLlib does; of n equal rows the weights add up to one draw of mean n. Draws are made once, by tasks that
each hold some of the cells, and the trees are grown side by side from the sums. Boosting has no draws.

The work over the rows is one grouping and one draw for each tree, whatever the depth. The number of cells is bounded by the ranges, not
by the rows; a table of more than ``MAX_CELLS`` cells is left to MLlib.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.functions.sizing import kept

# Tables of so many training rows go to MLlib as they are.
DIRECT_ROWS = 100_000
MAX_CELLS = 1 << 18
MAX_WIDTH = 64
MAX_BINS = 32
SAMPLE_ROWS = 10_000
# Distinct labels of one cell that one draw covers; a cell of more is dealt over several tasks.
BLOCK = 1 << 16
# Weights drawn at once: rows by trees.
DRAWS = 1 << 20
TASK_ROWS = 1_000_000
_NODES = "tree int, node int, feature int, bin int, lower int, upper int, score double, value array<double>"


def thresholds(values: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """Where a feature is cut, by MLlib's rule: between all values if they are few, else at equal shares of the rows."""
    found, counts = np.unique(values, return_counts=True)
    middle = (found[1:] + found[:-1]) / 2
    if len(found) <= bins:
        return middle
    stride = len(values) / bins
    at, reached, target = [], counts[0], stride
    for i in range(1, len(found)):
        before, reached = reached, reached + counts[i]
        if abs(before - target) < abs(reached - target):
            at.append(i - 1)
            target += stride
    return middle[at]


class Cells:
    """Ranges of the features, and one number for each combination of them."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.sizes = cuts, [len(c) + 1 for c in cuts]
        self.fits = math.prod(self.sizes) < 1 << 62

    def codes(self, points: np.ndarray) -> np.ndarray:
        code = np.zeros(len(points), np.int64)
        for j, cut in enumerate(self.cuts):
            code = code * self.sizes[j] + np.searchsorted(cut, points[:, j], "left")
        return code

    def bins(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(self.cuts)), np.int64)
        for j in range(len(self.cuts) - 1, -1, -1):
            codes, out[:, j] = np.divmod(codes, self.sizes[j])
        return out


def grow(bins: np.ndarray, sizes: list[int], w: np.ndarray, y: np.ndarray, depth: int, tried: int, rng: np.random.Generator | None, least: float) -> list[tuple]:
    """Nodes ``(feature, bin, lower, upper, score, value)`` of a tree over cells of weights ``w`` and weighted sums ``y`` (one column for a
    number, one a class); a leaf has feature -1. A split lowers the squared error, which for class counts is the Gini impurity.

    Levels are grown at once; each node tries ``tried`` features, and ``least`` is the fall of error by weight that counts as none.
    """
    width = len(sizes)
    nodes: list[list] = [[-1, 0, -1, -1, 0.0, None]]
    open_nodes = np.array([0])
    at = np.zeros(len(w), np.int64)
    for level in range(depth + 1):
        n = len(open_nodes)
        total = np.bincount(at, w, n)
        sums = np.stack([np.bincount(at, y[:, k], n) for k in range(y.shape[1])], 1)
        for i, node in enumerate(open_nodes):
            nodes[node][5] = sums[i] / total[i]
        if level == depth:
            break
        allowed = np.ones((n, width), bool)
        if tried < width:
            allowed = rng.random((n, width)).argsort(1).argsort(1) < tried
        best, feature, cut = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
        own = (sums ** 2).sum(1) / total
        for j, size in enumerate(sizes):
            if size < 2:
                continue
            slot = at * size + bins[:, j]
            left = np.bincount(slot, w, n * size).reshape(n, size).cumsum(1)[:, :-1]
            right = total[:, None] - left
            score = np.zeros_like(left)
            with np.errstate(divide="ignore", invalid="ignore"):
                for k in range(y.shape[1]):
                    part = np.bincount(slot, y[:, k], n * size).reshape(n, size).cumsum(1)[:, :-1]
                    score += part ** 2 / left + (sums[:, k, None] - part) ** 2 / right
            # weights are whole numbers, but for rounding
            score = np.where((left > 0.5) & (right > 0.5) & allowed[:, j, None], score - own[:, None], -np.inf)
            here = score.argmax(1)
            top = score[np.arange(n), here]
            better = top > best
            best, feature, cut = np.where(better, top, best), np.where(better, j, feature), np.where(better, here, cut)
        split = best > least * total
        lower = np.full(n, -1)
        following = []
        for i in np.flatnonzero(split):
            first = len(nodes)
            nodes[open_nodes[i]][:5] = [int(feature[i]), int(cut[i]), first, first + 1, float(best[i])]
            nodes += [[-1, 0, -1, -1, 0.0, None], [-1, 0, -1, -1, 0.0, None]]
            lower[i] = len(following)
            following += [first, first + 1]
        if not following:
            break
        inside = split[at]
        bins, w, y, at = bins[inside], w[inside], y[inside], at[inside]
        at = lower[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
        open_nodes = np.array(following)
    return [tuple(node) for node in nodes]


def leaves(nodes: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The leaf of every cell."""
    at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        feature = nodes["feature"][at]
        inner = feature >= 0
        if not inner.any():
            return at
        above = bins[row, np.maximum(feature, 0)] > nodes["bin"][at]
        at = np.where(inner, np.where(above, nodes["upper"][at], nodes["lower"][at]), at)


def _arrays(nodes: list[tuple]) -> dict[str, np.ndarray]:
    columns = dict(zip(("feature", "bin", "lower", "upper", "score", "value"), zip(*nodes)))
    return {name: np.array(column) for name, column in columns.items()}


def summed(bins: np.ndarray, trees: list[dict[str, np.ndarray]], weights: list[float]) -> np.ndarray:
    """The weighted sum of the trees' values for every cell."""
    out = np.zeros((len(bins), trees[0]["value"].shape[1]))
    for tree, weight in zip(trees, weights):
        out += weight * tree["value"][leaves(tree, bins)]
    return out


class BinnedTrees(Transformer):
    """The sum of weighted trees: a number, or votes of classes as ``rawPrediction`` with the largest as ``prediction``."""

    def __init__(self, cells: Cells, trees: list[dict[str, np.ndarray]], weights: list[float], classes: int | None):
        super().__init__()
        self.cells, self.trees, self.weights, self.classes = cells, trees, weights, classes

    @property
    def importances(self) -> np.ndarray:
        """Falls of error by feature; each tree of a forest counts alike, as in MLlib."""
        forest = len(set(self.weights)) == 1
        total = np.zeros(len(self.cells.cuts))
        for tree in self.trees:
            inner = tree["feature"] >= 0
            own = np.bincount(tree["feature"][inner], tree["score"][inner], len(total))
            total += own / (own.sum() or 1.0) if forest else own
        return total / (total.sum() or 1.0)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent = dataset.sparkSession.sparkContext.broadcast((self.cells.cuts, self.trees, self.weights))

        @F.pandas_udf("array<double>")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cuts, trees, weights = sent.value
            cells = Cells(cuts)
            for points in batches:
                if not len(points):
                    yield pd.Series([], dtype=object)
                    continue
                found, place = np.unique(cells.codes(np.vstack(points.to_numpy())), return_inverse=True)
                yield pd.Series(list(summed(cells.bins(found), trees, weights)[place]))

        found = dataset.withColumn("__scores", scored(vector_to_array("features")))
        if self.classes is None:
            return found.withColumn("prediction", F.col("__scores")[0]).drop("__scores")
        return found.withColumn("rawPrediction", array_to_vector("__scores")).withColumn(
            "prediction", (F.array_position("__scores", F.array_max("__scores")) - 1).cast("double")
        ).drop("__scores")


def _coded(table: DataFrame, cells: Cells) -> DataFrame:
    """(code, label) of the rows."""
    width = len(cells.cuts)

    def run(batches):
        for batch in batches:
            points = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(cells.codes(points)), batch.column("label")], names=["code", "label"])

    return table.select(vector_to_array("features").alias("x"), F.col("label").cast("double")).mapInArrow(run, "code long, label double")


def cells_of(table: DataFrame, rows: int, seed: int) -> Cells | None:
    """Ranges by a sample of about ``SAMPLE_ROWS`` rows; None if the features are too many to number their combinations."""
    points = table.select(vector_to_array("features").alias("x"))
    picked = points if rows <= SAMPLE_ROWS else points.where(F.rand(seed) < SAMPLE_ROWS / rows)
    sample = [r["x"] for r in picked.where(F.size("x") <= MAX_WIDTH).limit(2 * SAMPLE_ROWS).collect()]
    if not sample:
        return None
    cells = Cells([thresholds(column) for column in np.array(sample).T])
    return cells if cells.fits else None


def _drawn(groups: DataFrame, rows: int, trees: int, seed: int, by_label: bool) -> DataFrame:
    """(tree, code, label, w, y): each tree's weight of a cell and its weighted sum of labels, apart for every label if ``by_label``."""
    many = groups.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    # so many rows at most as there are blocks of labels
    dealt = groups.join(F.broadcast(many), "code", "left").withColumn("block", F.expr("if(blocks is null, 0L, pmod(xxhash64(label), blocks))"))
    # a row is small here and gives a draw for each tree
    tasks = max(4 * groups.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
    dealt = dealt.select("code", "block", "label", "n").repartition(tasks, "code", "block").sortWithinPartitions("code", "block", "label")

    def run(batches):
        most = max(1, DRAWS // trees)
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                code, block, label, n = (batch.column(c).to_numpy() for c in ("code", "block", "label", "n"))
                new = np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1]) | by_label]
                first = np.flatnonzero(new)
                w = np.empty((len(code), trees))
                for a, b in zip(first, np.r_[first[1:], len(code)]):
                    # by what is drawn for, not by the task that draws
                    rng = np.random.default_rng([seed & 0xFFFFFFFF, int(code[a]), int(block[a]), int(label[a:a + 1].view(np.uint64)[0])])
                    w[a:b] = rng.poisson(n[a:b, None], (b - a, trees))
                y = np.add.reduceat(w * label[:, None], first, axis=0)
                w = np.add.reduceat(w, first, axis=0)
                held, tree = np.nonzero(w)
                columns = [tree.astype(np.int32), code[first][held], label[first][held], w[held, tree], y[held, tree]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "code", "label", "w", "y"])

    return dealt.mapInArrow(run, "tree int, code long, label double, w double, y double")


def _forest(groups: DataFrame, rows: int, cells: Cells, trees: int, depth: int, tried: int, seed: int, classes: int | None, least: float) -> pd.DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        codes, place = np.unique(pdf["code"].to_numpy(), return_inverse=True)
        # in a fixed order, so that sums do not depend on how the rows arrive
        pdf, place = (lambda order: (pdf.iloc[order], place[order]))(np.lexsort((pdf["w"], pdf["y"], pdf["label"], place)))
        w = np.bincount(place, pdf["w"], len(codes))
        if classes is None:
            y = np.bincount(place, pdf["y"], len(codes))[:, None]
        else:
            y = np.bincount(place * classes + pdf["label"].to_numpy(np.int64), pdf["w"], len(codes) * classes).reshape(-1, classes)
        nodes = grow(cells.bins(codes), cells.sizes, w, y, depth, tried, np.random.default_rng([seed & 0xFFFFFFFF, tree]), least)
        frame = pd.DataFrame(nodes, columns=["feature", "bin", "lower", "upper", "score", "value"])
        frame.insert(0, "node", range(len(frame)))
        frame.insert(0, "tree", tree)
        return frame

    # a tree each, over as many tasks as there are trees
    return _drawn(groups, rows, trees, seed, classes is not None).repartition(trees, "tree").groupBy("tree").applyInPandas(build, _NODES).toPandas()


def _boosted(sums: DataFrame, cells: Cells, rounds: int, depth: int, step: float, least: float) -> list[list[tuple]]:
    """Trees of MLlib's boosting: the first of the labels, each next one of twice what is left (the gradient of the squared error)."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code")
        bins, n, y = cells.bins(pdf["code"].to_numpy()), pdf["n"].to_numpy(float), pdf["y"].to_numpy()
        reached, frames = np.zeros(len(n)), []
        for tree in range(rounds):
            wanted = y if not tree else 2 * (y - n * reached)
            nodes = grow(bins, cells.sizes, n, wanted[:, None], depth, len(cells.sizes), None, least)
            arrays = _arrays(nodes)
            reached = reached + (step if tree else 1.0) * arrays["value"][leaves(arrays, bins), 0]
            frame = pd.DataFrame(nodes, columns=["feature", "bin", "lower", "upper", "score", "value"])
            frame.insert(0, "node", range(len(frame)))
            frame.insert(0, "tree", tree)
            frames.append(frame)
        return pd.concat(frames)

    return sums.groupBy().applyInPandas(build, _NODES).toPandas()


def fit(table: DataFrame, rows: int, seed: int, *, trees: int, depth: int, classes: int | None = None, strategy: str = "all", step: float | None = None) -> BinnedTrees | None:
    """A forest of ``table`` (features, label), or with ``step`` boosted trees; None where MLlib has to do it."""
    if rows <= DIRECT_ROWS:
        return None
    cells = cells_of(table, rows, seed)
    if cells is None:
        return None
    coded = _coded(table, cells)
    boosting = step is not None
    groups = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")) if boosting else coded.groupBy("code", "label").agg(F.count(F.lit(1)).alias("n"))
    with kept(groups) as held:
        if held.select("code").distinct().count() * (classes or 1) > MAX_CELLS:
            return None
        if boosting:
            found = _boosted(held, cells, trees, depth, step, 1e-12)
        else:
            tried = math.ceil(math.sqrt(len(cells.cuts))) if strategy == "sqrt" else len(cells.cuts)
            found = _forest(held, rows, cells, trees, depth, tried, seed, classes, 1e-12)
    built = [{c: t[c].to_numpy() if c != "value" else np.vstack(t[c].to_numpy()) for c in ("feature", "bin", "lower", "upper", "score", "value")}
             for _, t in found.sort_values(["tree", "node"]).groupby("tree")]
    weights = [1.0 if not i else step for i in range(len(built))] if boosting else [1.0 if classes else 1.0 / len(built)] * len(built)
    return BinnedTrees(cells, built, weights, classes)
