"""Registered queries: every operator over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from columnscope.plans import aggregates, chart_data, models, profiles, reports, rows, series, sql_texts, statistics, tables

Query = Callable[[SparkSession, str], DataFrame]


def catalogue() -> dict[str, tuple[Query, str | None]]:
    """Name to (query, SQL or None where SQL cannot express it)."""
    found: dict[str, tuple[Query, str | None]] = {}
    for family in (
        rows, aggregates, profiles, statistics, series, chart_data, sql_texts, models, reports, tables,
    ):
        for name, entry in family.ENTRIES.items():
            if name in found:
                raise ValueError(f"query registered twice: {name}")
            found[name] = entry
    return found
