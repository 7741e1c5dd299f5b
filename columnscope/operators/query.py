"""Declarative query: filter, group, aggregate, sort, limit; plus paging and whole-row search."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnscope.errors import ValidationError
from columnscope.functions.columns import (
    ROW_ID,
    as_number,
    as_text,
    is_boolean,
    is_fractional,
    is_integral,
    is_missing,
    is_numeric,
    is_temporal,
    is_text,
    present,
    ref,
    require_columns,
    type_of,
    user_columns,
)
from columnscope.functions.quantiles import grouped_quantiles, join_same
from columnscope.functions.scalar import contains_ignore_case
from columnscope.operators import pages

# The names accepted in requests and the row limits.
AGGREGATIONS = ("sum", "mean", "median", "count", "min", "max", "std")
COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte")
FILTER_OPERATORS = (*COMPARISONS, "in", "not_in", "contains", "is_null", "not_null")
DEFAULT_RAW_LIMIT = 1000
MAX_LIMIT = 5000
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500


# ---------------------------------------------------------------- filters


def _never(keep: bool = False) -> Column:
    return F.lit(keep)


def _compare(column: Column, op: str, value: Column) -> Column:
    if op == "eq":
        return column == value
    if op == "ne":
        return ~column.eqNullSafe(value)
    return {"gt": column > value, "gte": column >= value, "lt": column < value, "lte": column <= value}[op]


def _number(value: Any) -> float | int | Decimal:
    if isinstance(value, (int, float, Decimal)):
        return value
    text = str(value).strip()
    try:
        return int(text)
    except ValueError:
        pass
    try:
        return float(text)
    except ValueError as e:
        raise ValidationError(f"Could not parse {value!r} as a number.") from e


def _compare_integral(column: Column, dtype: T.DataType, op: str, number: Any) -> Column:
    """Keep an integer column un-cast, so the comparison reaches the Parquet reader."""
    value = float(number) if not isinstance(number, int) else number
    if isinstance(value, float) and math.isnan(value):
        return column.isNull() | _never(True) if op == "ne" else _never()
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(dtype)]
    if value >= 2**bits or value < -(2**bits):
        above = value > 0
        if op == "eq":
            return _never()
        if op == "ne":
            return F.lit(True)
        matches_all = (op in ("lt", "lte")) if above else (op in ("gt", "gte"))
        return column.isNotNull() if matches_all else _never()
    if value == int(value):
        return _compare(column, op, F.lit(int(value)).cast(dtype))
    if op == "eq":
        return _never()
    if op == "ne":
        return F.lit(True)
    if op in ("gt", "gte"):
        return column >= F.lit(math.ceil(value)).cast(dtype)
    return column <= F.lit(math.floor(value)).cast(dtype)


def _moment(value: Any) -> pd.Timestamp:
    try:
        moment = pd.to_datetime(value)
    except (ValueError, TypeError) as e:
        raise ValidationError(f"Could not parse {value!r} as a date.") from e
    if not isinstance(moment, pd.Timestamp):
        raise ValidationError(f"Could not parse {value!r} as a date.")
    return moment


def _compare_temporal(column: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    if isinstance(value, bool) or not isinstance(value, (str, date, datetime)):
        raise ValidationError(f"Could not parse {value!r} as a date.")
    moment = _moment(value)
    if isinstance(dtype, T.DateType):
        if moment == moment.normalize() and moment.tzinfo is None:
            return _compare(column, op, F.lit(moment.strftime("%Y-%m-%d")).cast("date"))
        return _compare(column.cast("timestamp"), op, F.lit(moment.isoformat(sep=" ")).cast("timestamp"))
    return _compare(column, op, F.lit(moment.isoformat(sep=" ")).cast(dtype))


def _comparison(df: DataFrame, name: str, op: str, value: Any) -> Column:
    dtype, column = type_of(df, name), ref(name)
    if is_temporal(dtype):
        return _compare_temporal(column, dtype, op, value)
    if is_boolean(dtype):
        if isinstance(value, bool):
            return _compare(column, op, F.lit(value))
        return _compare(column.cast("double"), op, F.lit(float(_number(value))))
    if is_numeric(dtype):
        number = int(value) if isinstance(value, bool) else _number(value)
        if is_integral(dtype):
            return _compare_integral(column, dtype, op, number)
        if isinstance(dtype, T.DecimalType):
            try:
                return _compare(column, op, F.lit(Decimal(str(number))))
            except InvalidOperation as e:
                raise ValidationError(f"Could not parse {value!r} as a number.") from e
        test = _compare(column, op, F.lit(float(number)).cast(dtype if isinstance(dtype, T.DoubleType) else "double"))
        # Spark orders NaN above every number; a missing value must not be "greater".
        return test & ~F.isnan(column) if op in ("gt", "gte") else test
    if is_text(dtype):
        if isinstance(value, str):
            return _compare(column, op, F.lit(value))
        if op in ("eq", "ne"):
            return _never(op == "ne")
        raise ValidationError(f"Cannot order text column {name!r} against {value!r}.")
    raise ValidationError(f"Column {name!r} does not support {op!r}.")


def _membership(df: DataFrame, name: str, values: list[Any]) -> Column:
    """Members are taken as they are: a text never equals a number."""
    dtype, column = type_of(df, name), ref(name)
    known = [v for v in values if v is not None]
    if is_boolean(dtype):
        members = [bool(v) for v in known if isinstance(v, (bool, int, float)) and v in (0, 1)]
    elif is_numeric(dtype):
        members = [v for v in known if isinstance(v, (bool, int, float, Decimal))]
        members = [int(v) if isinstance(v, bool) else v for v in members]
        if is_integral(dtype):
            members = [int(v) for v in members if v == v and abs(v) < 2**63 and v == int(v)]
        else:
            members = [float(v) for v in members]
    elif is_temporal(dtype):
        members = [F.lit(_moment(v).isoformat(sep=" ")).cast(dtype) for v in known if isinstance(v, (date, datetime))]
    else:
        members = [v for v in known if isinstance(v, str)]
    test = column.isin(members) if members else _never()
    test = F.coalesce(test, F.lit(False)) if members else test
    return test | is_missing(df, name) if len(known) < len(values) else test


def predicate(df: DataFrame, spec: Mapping[str, Any]) -> Column:
    """Boolean column for one ``{column, operator, value}`` filter."""
    name, op, value = spec["column"], spec["operator"], spec.get("value")
    require_columns(df, [name], "filter")
    if op not in FILTER_OPERATORS:
        raise ValidationError(f"No filter is called {op!r}.")
    if op == "is_null":
        return is_missing(df, name)
    if op == "not_null":
        return ~is_missing(df, name) if is_fractional(type_of(df, name)) else ref(name).isNotNull()
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)):
            raise ValidationError(f"The filter {op!r} takes a list.")
        members = _membership(df, name, list(value))
        return members if op == "in" else ~members
    if op == "contains":
        return contains_ignore_case(as_text(df, name), str(value))
    if value is None:
        return _never(op == "ne")
    return _comparison(df, name, op, value)


def apply_filters(df: DataFrame, filters: Sequence[Mapping[str, Any]] | None) -> DataFrame:
    """All filters AND-ed into one condition, so Catalyst can push every conjunct to the scan."""
    if not filters:
        return df
    return df.where(reduce(lambda a, b: a & b, [predicate(df, f) for f in filters]))


def search_rows(df: DataFrame, text: str | None) -> DataFrame:
    """Rows where any column contains ``text``, ignoring case."""
    if not text:
        return df
    tests = [contains_ignore_case(as_text(df, c), text) for c in user_columns(df)]
    return df.where(reduce(lambda a, b: a | b, tests))


# ---------------------------------------------------------------- aggregation


def metric_alias(metric: Mapping[str, Any]) -> str:
    column = metric.get("column")
    return metric.get("alias") or (f"{metric['aggregation']}_{column}" if column else "count")


def check_metric(df: DataFrame, metric: Mapping[str, Any]) -> None:
    agg, column = metric["aggregation"], metric.get("column")
    if agg not in AGGREGATIONS:
        raise ValidationError(f"No aggregation is called {agg!r}.")
    if column is None:
        if agg != "count":
            raise ValidationError(f"{agg!r} needs the name of a column.")
        return
    require_columns(df, [column], "metric")
    if agg in ("sum", "mean", "median", "std") and not is_numeric(type_of(df, column), include_bool=True):
        raise ValidationError(f"Aggregation {agg!r} requires a numeric column, not {column!r}.")


def metric_column(df: DataFrame, agg: str, column: str | None) -> Column:
    """Aggregate expression of every metric but the median."""
    if agg == "count":
        return F.count(F.lit(1)) if column is None else F.count(present(df, column))
    value = present(df, column)
    if is_boolean(type_of(df, column)) and agg in ("sum", "mean", "median", "std"):
        value = value.cast("int")
    if agg == "sum":
        total = F.sum(value)
        zero = F.lit(0) if not is_fractional(type_of(df, column)) else F.lit(0.0)
        return F.coalesce(total, zero)
    if agg == "mean":
        return F.avg(value)
    if agg == "std":
        return F.stddev_samp(value)
    return F.min(value) if agg == "min" else F.max(value)


def aggregate(
    df: DataFrame, group_by: Sequence[str], metrics: Sequence[Mapping[str, Any]] | None = None
) -> DataFrame:
    """All metrics in one pass over the data; a missing key value is a group of its own."""
    require_columns(df, group_by, "group_by")
    metrics = list(metrics or [{"aggregation": "count"}])
    for metric in metrics:
        check_metric(df, metric)
    names = [*group_by, *[metric_alias(m) for m in metrics]]
    if len(set(names)) < len(names):
        raise ValidationError(f"Duplicate output columns: {names}")
    for key in group_by:
        if isinstance(type_of(df, key), T.MapType):
            raise ValidationError(f"Cannot group by map column {key!r}.")

    keys = [present(df, k).alias(k) for k in group_by]
    medians = [m for m in metrics if m["aggregation"] == "median"]
    direct = [m for m in metrics if m["aggregation"] != "median"]
    columns = [metric_column(df, m["aggregation"], m.get("column")).alias(metric_alias(m)) for m in direct]
    if not medians:
        return df.groupBy(*keys).agg(*columns) if group_by else df.agg(*columns)

    # Medians are located by counting (no group is gathered in one task) and joined to the other metrics.
    sources = sorted({m["column"] for m in medians})
    numbers = [as_number(df, c).alias(f"__m{i}") for i, c in enumerate(sources)]
    located = grouped_quantiles(
        df.select(*keys, *numbers), list(group_by), [f"__m{i}" for i in range(len(sources))], [0.5]
    ).select(
        *[ref(k) for k in group_by],
        *[F.get(ref(f"__m{sources.index(m['column'])}"), F.lit(0)).alias(metric_alias(m)) for m in medians],
    )
    if direct and group_by:
        located = join_same(df.groupBy(*keys).agg(*columns), located, list(group_by), "left")
    elif direct:
        located = df.agg(*columns).join(located, F.lit(True), "left")  # one row each
    return located.select(*[ref(n) for n in names])


# ---------------------------------------------------------------- ordering, limits


def orderable(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not _holds_map(type_of(df, c))]


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return False


def row_order(df: DataFrame, skip: Sequence[str] = ()) -> list[Column]:
    """A total order: stored row number if there is one, else every orderable column."""
    names = [ROW_ID] if ROW_ID in df.columns else [c for c in orderable(df) if c not in skip]
    return [ref(c).asc_nulls_last() for c in names]


def _sorted_by(df: DataFrame, name: str, direction: str) -> list[Column]:
    key = present(df, name)
    first = key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last()
    return [first, *row_order(df, skip=[name])]


def _shaped(
    df: DataFrame,
    filters: Sequence[Mapping[str, Any]] | None,
    group_by: Sequence[str] | None,
    metrics: Sequence[Mapping[str, Any]] | None,
) -> DataFrame:
    working = apply_filters(df, filters)
    return aggregate(working, list(group_by or []), metrics) if group_by or metrics else working


def _cap(limit: int | None, raw: bool) -> int | None:
    if limit is None:
        return DEFAULT_RAW_LIMIT if raw else None
    if limit < 1:
        raise ValidationError("limit must be at least 1.")
    return min(limit, MAX_LIMIT)


def run_query(
    df: DataFrame,
    *,
    filters: Sequence[Mapping[str, Any]] | None = None,
    group_by: Sequence[str] | None = None,
    metrics: Sequence[Mapping[str, Any]] | None = None,
    sort: Mapping[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Lazy result of a query request. Raw rows are capped at 1,000 by default, any limit at 5,000."""
    raw = not (group_by or metrics)
    result = _shaped(df, filters, group_by, metrics)
    cap = _cap(limit, raw)
    if sort:
        if sort["by"] not in result.columns:
            raise ValidationError(
                f"Unknown sort column: {sort['by']!r}", details={"available": list(result.columns)}
            )
        result = result.orderBy(*_sorted_by(result, sort["by"], sort.get("direction", "desc")))
    elif raw:
        result = result.orderBy(*row_order(result))
    elif group_by:
        result = result.orderBy(*[ref(k).asc_nulls_last() for k in group_by])
    return result.limit(cap) if cap is not None else result


def query_summary(
    df: DataFrame,
    *,
    filters: Sequence[Mapping[str, Any]] | None = None,
    group_by: Sequence[str] | None = None,
    metrics: Sequence[Mapping[str, Any]] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One row: returned rows, matched rows, whether the limit cut anything. Runs no sort."""
    cap = _cap(limit, not (group_by or metrics))
    return capped_summary(_shaped(df, filters, group_by, metrics), cap)


def capped_summary(result: DataFrame, cap: int | None) -> DataFrame:
    total = F.count(F.lit(1))
    returned = F.least(total, F.lit(cap).cast("long")) if cap is not None else total
    return result.agg(
        returned.alias("row_count"),
        total.alias("total_matched_rows"),
        (returned < total).alias("truncated"),
    )


# ---------------------------------------------------------------- preview


def _page_bounds(page: int, page_size: int) -> tuple[int, int]:
    return max(1, page), max(1, min(page_size, MAX_PAGE_SIZE))


def preview(
    df: DataFrame,
    *,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    sort: str | None = None,
    sort_dir: str = "asc",
    search: str | None = None,
) -> DataFrame:
    """One page of rows in a stable order; an unknown sort column is ignored."""
    page, page_size = _page_bounds(page, page_size)
    start = (page - 1) * page_size
    if ROW_ID in df.columns and not search and sort not in df.columns:
        # Row numbers are dense: the page is a range the Parquet reader can skip to, however deep it is.
        return df.where(ref(ROW_ID).between(start, start + page_size - 1)).orderBy(ref(ROW_ID))
    rows = search_rows(df, search)
    falling = sort_dir == "desc"
    order = _sorted_by(rows, sort, "desc" if falling else "asc") if sort in df.columns else row_order(rows)
    if start > pages.SHALLOW:
        ties = [ROW_ID] if ROW_ID in df.columns else [c for c in orderable(df) if c != sort]
        rows, start = pages.skipped(rows, [*([(sort, falling)] if sort in df.columns else []), *((c, False) for c in ties)], start)
    return rows.orderBy(*order).offset(start).limit(page_size)


def preview_info(
    df: DataFrame, *, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE, search: str | None = None
) -> DataFrame:
    """One row: page, page_size, total_rows, total_pages."""
    page, page_size = _page_bounds(page, page_size)
    total = F.count(F.lit(1))
    pages = F.greatest(F.lit(1), F.ceil(total / F.lit(page_size))).cast("long")
    return search_rows(df, search).agg(
        F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
        total.alias("total_rows"), pages.alias("total_pages"),
    )


def trim_arrays(df: DataFrame, keep: int = 20) -> DataFrame:
    """Shorten every array column to ``keep`` items; ``<name>_cut`` says how many were left out."""
    columns: list[Column] = []
    for name in df.columns:
        if isinstance(type_of(df, name), T.ArrayType):
            columns.append(F.slice(ref(name), 1, keep).alias(name))
            columns.append(F.greatest(F.size(ref(name)) - keep, F.lit(0)).alias(f"{name}_cut"))
        else:
            columns.append(ref(name))
    return df.select(*columns)
