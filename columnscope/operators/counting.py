"""Frequency, distinct and duplicate counting over all columns at once.

Every column is turned into rows of ``(position, integer, double, text)`` with one value slot filled, and a
single hash aggregation counts them: partial counts are combined before the shuffle, so a value held by a
third of the rows costs one row per task. Long texts are represented by their SHA-256 digest, which keeps
free text from being shuffled whole; a digest has 64 characters and only longer texts are digested, so a
digest never equals a text that was kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnscope.functions.columns import (
    is_boolean,
    is_fractional,
    is_integral,
    is_nested,
    is_text,
    present,
    ref,
    type_of,
    user_columns,
)
from columnscope.functions.sizing import kept

DIGEST_CHARS = 64


def compact_text(text: Column) -> Column:
    return F.when(F.octet_length(text) >= DIGEST_CHARS, F.sha2(text, 256)).otherwise(text)


def rendered(df: DataFrame, name: str) -> Column:
    """Text of a column that has no plain number or instant behind it."""
    dtype = type_of(df, name)
    if is_nested(dtype):
        return F.to_json(ref(name))
    if isinstance(dtype, T.BinaryType):
        return F.hex(ref(name))
    return ref(name).cast("string")


def _slots(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    dtype = type_of(df, name)
    no_int, no_double, no_text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if is_integral(dtype) or is_boolean(dtype):
        return (ref(name).cast("int") if is_boolean(dtype) else ref(name)).cast("bigint"), no_double, no_text
    if isinstance(dtype, T.DateType):
        return F.unix_date(ref(name)).cast("bigint"), no_double, no_text
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(ref(name).cast("timestamp")), no_double, no_text
    if is_fractional(dtype):
        return no_int, present(df, name).cast("double") + F.lit(0.0), no_text
    return no_int, no_double, compact_text(rendered(df, name))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``pos, i, d, s, n``: rows per distinct non-missing value of every column, from one shuffle."""
    columns = columns if columns is not None else user_columns(df)
    cells = []
    for pos, name in enumerate(columns):
        as_int, as_double, as_str = _slots(df, name)
        cells += [F.lit(pos), as_int, as_double, as_str]
    long = df.select(F.stack(F.lit(len(columns)), *cells).alias("pos", "i", "d", "s"))
    long = long.where("i is not null or d is not null or s is not null")
    return long.groupBy("pos", "i", "d", "s").agg(F.count(F.lit(1)).alias("n"))


def distinct_and_top(df: DataFrame, columns: list[str], k: int) -> tuple[dict[str, int], dict[str, list]]:
    """Exact distinct count of every column, and the ``k`` most frequent values of the text columns.

    The count table is computed once and read twice. The top-k window carries a rank limit, which Spark applies
    inside each task before its shuffle.
    """
    if not columns:
        return {}, {}
    none = F.lit(None)
    order = W.partitionBy("pos").orderBy(F.col("n").desc(), F.col("s").asc())
    with kept(value_counts(df, columns)) as counts:
        distinct = counts.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).select(
            "pos", "n", none.cast("string").alias("s"), none.cast("int").alias("rank")
        )
        top = (
            counts.where("s is not null")
            .select("pos", "n", "s", F.row_number().over(order).alias("rank"))
            .where(F.col("rank") <= k)
        )
        found = distinct.unionByName(top).orderBy("pos", "rank").collect()  # at most k + 1 rows per column
    uniques = dict.fromkeys(columns, 0)
    best: dict[str, list] = {c: [] for c in columns}
    for row in found:
        name = columns[row["pos"]]
        if row["rank"] is None:
            uniques[name] = row["n"]
        else:
            best[name].append((row["s"], row["n"]))
    return uniques, {c: _restore(df, c, values) for c, values in best.items() if values}


def _restore(df: DataFrame, name: str, values: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Replace digests among the top values by the texts they stand for."""
    digests = [v for v, _ in values if len(v.encode()) == DIGEST_CHARS]
    if not digests:
        return values
    text = rendered(df, name)
    rows = (
        df.select(text.alias("t"))
        .where(F.octet_length("t") >= DIGEST_CHARS)
        .select("t", F.sha2("t", 256).alias("digest"))
        .where(F.col("digest").isin(digests))
        .groupBy("digest")
        .agg(F.min("t").alias("t"))
        .collect()
    )
    texts = {r["digest"]: r["t"] for r in rows}
    return sorted(((texts.get(v, v), n) for v, n in values), key=lambda p: (-p[1], p[0]))


def row_key(df: DataFrame) -> list[Column]:
    """Columns that identify a row's content; NULL equals NULL, and NaN counts as NULL."""
    keys = []
    for name in user_columns(df):
        dtype = type_of(df, name)
        if is_text(dtype) or is_nested(dtype) or isinstance(dtype, T.BinaryType):
            keys.append(compact_text(rendered(df, name)).alias(name))
        else:
            keys.append(present(df, name).alias(name))
    return keys


def row_digest(df: DataFrame) -> tuple[Column, Column]:
    """128 bits that stand for a row's content, as two columns. Missing values count by their place; -0.0 equals 0.0."""
    cells = []
    for key, name in zip(row_key(df), user_columns(df)):
        value = F.when(key == 0, F.lit(0)).otherwise(key) if is_fractional(type_of(df, name)) else key
        cells += [value, key.isNull()]
    return F.xxhash64(F.lit(0), *cells), F.xxhash64(F.lit(1), *cells)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total rows and how many repeat an earlier one.

    Rows are shuffled as digests of 16 bytes, counted in each task before, whatever their width. Among 10^12 rows the odds that
    any two different ones share a digest are about 1 in 10^15.
    """
    first, second = row_digest(df)
    copies = df.select(first.alias("d1"), second.alias("d2")).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(
        F.coalesce(F.sum("__copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )
