"""Pearson, Spearman and Kendall (tau-b) correlation of numeric columns, pairwise complete.

No plan here has a step whose group grows without bound:

* Pearson is one aggregation over (pair, a, b) rows.
* Spearman and Kendall take ranks from one index of all columns (``ranks.py``): the rows are shuffled twice, as cells and back
  to rows, however many columns there are.
* Kendall reads dense ranks as numbers of a few digits and counts pairs by the digits in which they differ first: each kind
  in grids of bounded size, on cells that are added up before they are shuffled. No pair of rows is formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import as_number, ref, require_numeric
from columnscope.functions.sizing import materialise, shared_scan
from columnscope.operators.ranks import cells_of, distinct_values, rank_index, ranked_rows

METHODS = ("pearson", "spearman", "kendall")
STRONG = 0.7
# Bits of a rank that make one digit: a grid of pairs has at most 2^20 cells.
DIGIT_BITS = 10


def correlation_columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    names = require_numeric(df, columns)
    if len(names) < 2:
        raise ValidationError(
            "Correlation takes two numeric columns or more.",
            details={"numeric_columns": names},
        )
    return names


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[as_number(df, n).alias(f"c{i}") for i, n in enumerate(names)])


def _pairs(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i, width)]


def _stacked(pairs: list[tuple[int, int]], cells: list[str], names: str) -> str:
    """``stack`` over the pairs; each entry of ``cells`` is a template of ``{i}`` and ``{j}``."""
    rows = [", ".join([f"{i}, {j}", *[c.format(i=i, j=j) for c in cells]]) for i, j in pairs]
    return f"stack({len(pairs)}, {', '.join(rows)}) as (i, j, {names})"


def _clipped(r: str) -> str:
    """Rounding noise beyond +-1 removed; NULL (a constant column) stays NULL."""
    return f"case when {r} > 1 then 1d when {r} < -1 then -1d else {r} end"


def _pearson(df: DataFrame, names: list[str]) -> DataFrame:
    long = _numbers(df, names).selectExpr(_stacked(_pairs(len(names)), ["c{i}", "c{j}"], "a, b"))
    return (
        long.where("a is not null and b is not null")
        .groupBy("i", "j")
        .agg(F.expr("try_divide(covar_samp(a, b), stddev_samp(a) * stddev_samp(b))").alias("r"))
        .selectExpr("i", "j", f"{_clipped('r')} as r")
    )


def _spearman(df: DataFrame, names: list[str]) -> DataFrame:
    width = len(names)
    numbers = _numbers(df, names)
    # A column is ranked once over all rows, and once more over the rows in which a column with gaps is present.
    nulls = numbers.selectExpr(*[f"count_if(c{i} is null) as c{i}" for i in range(width)]).first()
    gaps = [i for i in range(width) if nulls[i]]
    weights = {None: "m", **{g: f"m{g}" for g in gaps}}
    cells = cells_of(numbers, width, "1L as m", *[f"if(c{g} is null, 0L, 1L) as m{g}" for g in gaps])
    index = materialise(rank_index(distinct_values(cells, list(weights.values())), list(weights.values())))
    facts = [f for w in weights.values() for f in (w, f"{w}_below")]
    rows = ranked_rows(numbers, width, index, "m", facts)

    def of(i: int, j: int) -> str:
        """Rank of column i over the rows in which j is present too."""
        return f"r{i}" + (f"_{j}" if j in weights and j != i else "")

    needed = dict.fromkeys((i, j if j in weights and j != i else None) for i, j in _pairs(width) for i, j in ((i, j), (j, i)))
    needed.update(((i, None), None) for i in range(width))
    rows = rows.selectExpr("w", *[f"{weights[m]}_below_{i} + ({weights[m]}_{i} + 1) / 2 as {of(i, -1 if m is None else m)}" for i, m in needed])
    # a rank over the rows in which j is present means nothing in a row without it
    present = {i: of(i, -1) for i in range(width)}
    stacked = ", ".join(f"{i}, {j}, if({present[j]} is null, null, {of(i, j)}), if({present[i]} is null, null, {of(j, i)}), w" for i, j in _pairs(width))
    long = rows.selectExpr(f"stack({len(_pairs(width))}, {stacked}) as (i, j, a, b, w)")
    return (
        long.where("a is not null and b is not null")
        .groupBy("i", "j")
        .agg(
            *[F.expr(e) for e in (
                "sum(w) as n", "sum(w * a) as sa", "sum(w * b) as sb", "sum(w * a * b) as sab",
                "sum(w * a * a) as saa", "sum(w * b * b) as sbb",
            )]
        )
        .selectExpr(
            "i", "j",
            _clipped("try_divide(sab - sa * sb / n, sqrt(saa - sa * sa / n) * sqrt(sbb - sb * sb / n))") + " as r",
        )
    )


def count_concordant(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted number of point pairs with both coordinates strictly larger, by binary splits on ``x``."""
    ranks = np.unique(x, return_inverse=True)[1]
    order = np.argsort(y, kind="stable")
    ranks, y, weight = ranks[order], y[order], weight[order].astype("float64")
    total = 0.0
    for level in range(int(ranks.max()).bit_length()):
        block = ranks >> (level + 1)
        by_block = np.argsort(block, kind="stable")
        b, v, w = block[by_block], y[by_block], weight[by_block]
        upper = ((ranks[by_block] >> level) & 1).astype(bool)
        low = np.where(upper, 0.0, w)
        before = np.cumsum(low) - low
        new_block = np.concatenate(([True], b[1:] != b[:-1]))
        new_value = new_block | np.concatenate(([True], v[1:] != v[:-1]))
        at_block = np.maximum.accumulate(np.where(new_block, np.arange(len(b)), 0))
        at_value = np.maximum.accumulate(np.where(new_value, np.arange(len(b)), 0))
        smaller = before[at_value] - before[at_block]
        total += float((w * smaller)[upper].sum())
    return total


def _grid_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Concordant pairs inside every grid of rows (i, j, grid, x, y, w) that come grid by grid; one grid is held at a time, or some small ones."""
    rest = None

    def counted(rows: pd.DataFrame) -> pa.RecordBatch:
        out = []
        for (i, j), own in rows.groupby(["i", "j"], sort=False):
            # later grids lie to the right and below, so that pairs of different grids are never concordant
            grid = (own["grid"] != own["grid"].shift()).cumsum().to_numpy()
            span = 1 << DIGIT_BITS
            out.append((i, j, count_concordant(grid * span + own["x"].to_numpy(), own["y"].to_numpy() - grid * span, own["w"].to_numpy())))
        columns = list(zip(*out)) or [()] * 3
        kinds = (pa.int32(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["i", "j", "concordant"])

    for batch in batches:
        rows = batch.to_pandas()
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        key = rows[["i", "j", "grid"]]
        open_rows = (key == key.iloc[-1]).all(axis=1).to_numpy() if len(rows) else np.zeros(0, bool)
        yield counted(rows[~open_rows])
        rest = rows[open_rows]
    if rest is not None and len(rest):
        yield counted(rest)


def _kendall(df: DataFrame, names: list[str]) -> DataFrame:
    width = len(names)
    numbers = _numbers(df, names)
    index = materialise(rank_index(distinct_values(cells_of(numbers, width, "1L as m"), ["m"]), ["m"]))
    tops = {r["pos"]: r["top"] for r in index.groupBy("pos").agg(F.max("dense").alias("top")).collect()}
    rows = ranked_rows(numbers, width, index, "m", ["dense"])
    pairs = [(i, j) for i, j in _pairs(width) if i < j]
    points = materialise(
        rows.selectExpr(_stacked(pairs, ["dense_{i}", "dense_{j}", "w"], "x, y, w0"))
        .where("x is not null and y is not null").groupBy("i", "j", "x", "y").agg(F.sum("w0").alias("w"))
    )
    # Ranks are numbers of a few digits. Two points that differ first at digit a of x and digit b of y have the higher digits in
    # common: for each (a, b) they lie in one grid of at most 2^DIGIT_BITS by 2^DIGIT_BITS cells, and in no other.
    digits = max(1, -(-max(tops.values(), default=0).bit_length() // DIGIT_BITS))
    levels = ", ".join(f"named_struct('a', {a}, 'b', {b})" for a in range(digits) for b in range(digits))
    last = (1 << DIGIT_BITS) - 1
    grids = (
        points.selectExpr("i", "j", "x", "y", "w", f"explode(array({levels})) as level")
        .selectExpr(
            "i", "j", f"named_struct('a', level.a, 'b', level.b, 'x', shiftright(x, {DIGIT_BITS} * (level.a + 1)), 'y', shiftright(y, {DIGIT_BITS} * (level.b + 1))) as grid",
            f"shiftright(x, {DIGIT_BITS} * level.a) & {last} as x", f"shiftright(y, {DIGIT_BITS} * level.b) & {last} as y", "w",
        )
        .groupBy("i", "j", "grid", "x", "y").agg(F.sum("w").alias("w"))
        .repartition("i", "j", "grid").sortWithinPartitions("i", "j", "grid").withColumn("grid", F.xxhash64("grid.a", "grid.b", "grid.x", "grid.y"))
    )
    concordant = grids.mapInArrow(_grid_counts, "i int, j int, concordant double").groupBy("i", "j").agg(F.sum("concordant").alias("concordant"))
    tie = "sum(cast(w as double) * (w - 1)) / 2"
    joint_ties = points.groupBy("i", "j").agg(F.expr(f"{tie} as xy"), F.expr("sum(w) as n"))
    ties_x = points.groupBy("i", "j", "x").agg(F.sum("w").alias("w")).groupBy("i", "j").agg(F.expr(f"{tie} as tx"))
    ties_y = points.groupBy("i", "j", "y").agg(F.sum("w").alias("w")).groupBy("i", "j").agg(F.expr(f"{tie} as ty"))
    facts = joint_ties.join(ties_x, ["i", "j"]).join(ties_y, ["i", "j"]).join(concordant, ["i", "j"], "left")
    all_pairs = "cast(n as double) * (n - 1) / 2"
    score = f"2 * coalesce(concordant, 0) - ({all_pairs} - tx - ty + xy)"
    found = facts.selectExpr(
        "i", "j", _clipped(f"try_divide({score}, sqrt({all_pairs} - tx) * sqrt({all_pairs} - ty))") + " as r"
    )
    # a column agrees with itself unless it is constant
    own = [(i, i, 1.0 if tops.get(i, 0) > 0 else None) for i in range(width)]
    return found.unionAll(df.sparkSession.createDataFrame(own, "i int, j int, r double"))


_BY_METHOD = {"spearman": _spearman, "kendall": _kendall}


def pair_coefficients(df: DataFrame, names: list[str], method: str = "pearson") -> dict[tuple[int, int], float | None]:
    """Unrounded coefficient of every pair ``i <= j``; one small row per pair."""
    if method not in METHODS:
        raise ValidationError(f"No correlation is called {method!r}.")
    if method == "pearson":  # one pass
        rows = _pearson(df, names).collect()
    else:
        with shared_scan(df.select(*[ref(n) for n in names])) as table:
            rows = _BY_METHOD[method](table, names).collect()
    found = {(row["i"], row["j"]): row["r"] for row in rows}
    return {pair: found.get(pair) for pair in _pairs(len(names))}


def correlation(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Full matrix in long form: ``column_a, column_b, correlation`` (4 digits, NULL where undefined)."""
    names = correlation_columns(df, columns)
    found = pair_coefficients(df, names, method)
    rows = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            r = found[min(i, j), max(i, j)]
            rows.append((a, b, None if r is None or r != r else round(r, 4)))
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def strong_pair_records(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> list[dict]:
    names = correlation_columns(df, columns)
    pairs = [
        {"column_a": names[i], "column_b": names[j], "correlation": round(r, 4)}
        for (i, j), r in pair_coefficients(df, names, method).items()
        if i < j and r is not None and r == r and abs(r) >= STRONG
    ]
    return sorted(pairs, key=lambda p: -abs(p["correlation"]))


def strong_pairs(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Pairs with ``|r| >= 0.7``, strongest first."""
    rows = [tuple(p.values()) for p in strong_pair_records(df, columns, method)]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")
