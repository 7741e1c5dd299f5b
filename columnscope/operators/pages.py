"""Deep pages of a sorted table: rows before the page are counted in ranges of the sort key, never gathered.

``offset`` alone keeps all rows before a page in one heap. Here the key is cut into ranges of about equal counts, one small
aggregation says which range holds the page's first row, and rows of earlier ranges are left out by a condition. Inside the
range this is done again until few rows are left to skip; rows that share one key value are told apart by the next key. A
text counts by its bytes, six at a time, as numbers that rise with it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnscope.functions.buckets import ValueBuckets
from columnscope.functions.columns import is_numeric, is_text, present, type_of

# So many rows may be skipped by the offset of a sort.
SHALLOW = 10_000
RANGES = 1024
_CHUNK = 6


def _numbers(df: DataFrame, name: str) -> Iterator[Column]:
    """The column as numbers that never fall where it rises, most significant first; none for other types.

    Takes the one value that all rows share so far, and ends when that tells the whole value.
    """
    value, dtype = present(df, name), type_of(df, name)
    if is_numeric(dtype, include_bool=True):
        yield value.cast("double")
    elif isinstance(dtype, T.DateType):
        yield F.unix_date(value).cast("double")
    elif isinstance(dtype, T.TimestampType):
        yield F.unix_micros(value).cast("double")
    elif is_text(dtype):
        digits, at, shared = F.hex(F.encode(value, "UTF-8")), 1, None
        # a last byte of zero: the text has ended, and its length tells it from one that goes on with such bytes
        while shared is None or shared % 256:
            part = F.rpad(F.substring(digits, at, 2 * _CHUNK), 2 * _CHUNK, "0")
            shared = yield F.when(value.isNotNull(), F.conv(part, 16, 10).cast("double"))
            at += 2 * _CHUNK
        yield F.octet_length(value).cast("double")


def _range_of(rows: DataFrame, key: Column, descending: bool, start: int) -> tuple[int, float | None, float | None, bool]:
    """(rows before, low, high, one value) of the range that holds row ``start``; both bounds are None for missing keys, which come last."""
    numbers = rows.select(key.alias("k"))
    buckets = ValueBuckets.fit(numbers, ["k"], RANGES)
    counts = {r["k__range"]: r["count"] for r in buckets.assign(numbers).groupBy("k__range").count().collect()}  # at most two rows for each range
    before = 0
    for at in sorted((r for r in counts if r is not None), reverse=descending):
        if start < before + counts[at]:
            cuts = buckets.splits["k"]
            return before, cuts[at], cuts[at + 1], at in set(buckets.single_ids("k"))
        before += counts[at]
    return before, None, None, True


def skipped(rows: DataFrame, order: list[tuple[str, bool]], start: int) -> tuple[DataFrame, int]:
    """``rows`` without those of ranges before row ``start`` in the order of the named columns (with a flag for falling ones), and how many are still to be skipped."""
    inside, later = F.lit(True), F.lit(False)
    for name, descending in order:
        keys = _numbers(rows, name)
        key = next(keys, None)
        if key is None:
            break
        low, high = float("-inf"), float("inf")
        while key is not None and start > SHALLOW:
            before, new_low, new_high, one = _range_of(rows.where(inside), key, descending, start)
            start -= before
            if new_low is None:
                inside = inside & key.isNull()
                break
            beyond = (key < new_low) if descending else (key >= new_high)
            later = later | (inside & (beyond | key.isNull()))
            inside = inside & (key >= new_low) & (key < new_high)
            if one:
                low, high = float("-inf"), float("inf")
                try:
                    key = keys.send(new_low)
                except StopIteration:
                    key = None
            elif before == 0 and (new_low, new_high) == (low, high):
                return rows.where(F.coalesce(inside | later, F.lit(False))), start
            else:
                low, high = new_low, new_high
        if start <= SHALLOW:
            break
    return rows.where(F.coalesce(inside | later, F.lit(False))), start
