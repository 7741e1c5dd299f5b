"""Column references, type predicates and missing-value rules shared by all operators.

A missing value is NULL or NaN. Stored tables never hold NaN (``sources.store`` removes it), but every
operator also accepts foreign tables, so NaN is folded to NULL where a value is *consumed* and never in a
projection under a filter: wrapping the scan would stop Parquet predicate push-down.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnscope.errors import ValidationError

ROW_ID = "_row_id"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def ref(name: str) -> Column:
    """Reference a column by its literal name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FRACTIONAL)


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEMPORAL)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(dtype: T.DataType, include_bool: bool = False) -> bool:
    """Numbers; filters, charts and model features also take booleans (``include_bool``)."""
    if is_boolean(dtype):
        return include_bool
    return isinstance(dtype, _INTEGRAL + _FRACTIONAL + (T.DecimalType,))


def user_columns(df: DataFrame) -> list[str]:
    """All columns but the technical row number added at ingest."""
    return [c for c in df.columns if c != ROW_ID]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in user_columns(df) if is_numeric(type_of(df, c))]


def require_columns(df: DataFrame, names: Iterable[str], label: str = "") -> None:
    known = set(df.columns)
    for name in names:
        if name not in known:
            kind = f"{label} column" if label else "column"
            raise ValidationError(f"Unknown {kind}: {name!r}", details={"available": user_columns(df)})


def require_numeric(df: DataFrame, names: Iterable[str] | None) -> list[str]:
    """The requested numeric columns, or all of them; typed error for anything else."""
    numeric = numeric_columns(df)
    if not names:
        return numeric
    bad = [n for n in names if n not in numeric]
    if bad:
        raise ValidationError(
            f"Columns are not numeric or not found: {bad}", details={"numeric_columns": numeric}
        )
    return list(names)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL."""
    if is_fractional(type_of(df, name)):
        return F.nanvl(ref(name), F.lit(None).cast(type_of(df, name)))
    return ref(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if is_fractional(type_of(df, name)):
        return ref(name).isNull() | F.isnan(ref(name))
    return ref(name).isNull()


def as_number(df: DataFrame, name: str) -> Column:
    """Double view of a column: booleans are 0/1, unparseable text is NULL, -0.0 is 0.0."""
    dtype = type_of(df, name)
    if is_text(dtype):
        value = ref(name).try_cast("double")
        value = F.nanvl(value, F.lit(None).cast("double"))
    elif is_boolean(dtype):
        value = ref(name).cast("int").cast("double")
    elif is_numeric(dtype):
        value = present(df, name).cast("double")
    else:
        value = F.lit(None).cast("double")
    return value + F.lit(0.0)


def as_text(df: DataFrame, name: str) -> Column:
    """String form used by substring search; nested values are rendered as JSON."""
    dtype = type_of(df, name)
    if is_nested(dtype):
        return F.to_json(ref(name))
    return present(df, name).cast("string")


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column (used when a table is stored)."""
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def json_number(value: Column) -> Column:
    """NULL for NaN and both infinities: JSON has none of them."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)).otherwise(value)
