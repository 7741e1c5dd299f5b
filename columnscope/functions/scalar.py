"""Scalar helpers: ratios, rounding, words, mixed-format dates, ISO rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRANULARITY_UNIT = {"D": "day", "W": "week", "M": "month"}

# Span limits, in days, for daily and weekly buckets.
DAILY_MAX_SPAN = 60
WEEKLY_MAX_SPAN = 730

# The date spellings that are recognised in text, as (pattern, reader). ``None`` means Spark's
# own ISO cast. A pattern decides which single reader runs, so text that is no date never reaches a parser.
DATE_SPELLINGS: tuple[tuple[str, str | None], ...] = (
    (r"^\d{4}-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?)?$", None),
    (r"^\d{4}$", None),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "MMM d yyyy"),
)
DATE_MAX_CHARS = 40


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percentage(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.bround(F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0)), digits)


def contains_ignore_case(text: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test; NULL text never matches."""
    return F.coalesce(F.contains(F.lower(text), F.lower(F.lit(needle))), F.lit(False))


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))


def parse_timestamp(value: Column, dtype: T.DataType) -> Column:
    """Timestamp view of a date, timestamp or text column; anything unreadable is NULL."""
    if isinstance(dtype, T.TimestampType):
        return value
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return value.cast("timestamp")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp")
    text = F.trim(value)
    parsed = None
    for pattern, fmt in DATE_SPELLINGS:
        read = text.try_cast("timestamp") if fmt is None else F.try_to_timestamp(text, F.lit(fmt))
        test = text.rlike(pattern)
        parsed = F.when(test, read) if parsed is None else parsed.when(test, read)
    looks_short = (F.length(text) <= DATE_MAX_CHARS) & text.rlike(r"\d{4}")
    return F.when(looks_short, parsed)


def whole_days(earlier: Column, later: Column) -> Column:
    """Elapsed whole days, floored (not the calendar difference)."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def period_start(ts: Column, granularity: str) -> Column:
    """First instant of the day, ISO week (Monday) or month."""
    return F.date_trunc(GRANULARITY_UNIT[granularity], ts)


def granularity_for(span_days: int | None) -> str:
    if span_days is None or span_days <= DAILY_MAX_SPAN:
        return "D"
    return "W" if span_days <= WEEKLY_MAX_SPAN else "M"


def iso_text(ts: Column) -> Column:
    """ISO-8601 text, with microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(fraction)
