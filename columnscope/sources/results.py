"""JSON-safe rows, the result log, session timelines, the profile cache and the report sink."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import is_fractional, is_temporal, json_number, ref, type_of
from columnscope.functions.scalar import iso_text, parse_timestamp
from columnscope.operators.profile import Profile, profile

KINDS = ("table", "chart", "sql", "forecast")


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, instants become ISO-8601 text."""
    columns = []
    for name in df.columns:
        dtype = type_of(df, name)
        if is_fractional(dtype):
            columns.append(json_number(ref(name)).alias(name))
        elif is_temporal(dtype):
            columns.append(iso_text(parse_timestamp(ref(name), dtype)).alias(name))
        else:
            columns.append(ref(name))
    return df.select(*columns)


def json_records(df: DataFrame) -> DataFrame:
    """One ``json`` object per row, NULL fields kept."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[ref(c) for c in safe.columns]), {"ignoreNullFields": "false"}).alias("json"))


def append_result(path: str, session_id: str, kind: str, spec: dict[str, Any], result: DataFrame) -> str:
    """Append a result to the log, one log row per result row (no result is gathered into one value)."""
    if kind not in KINDS:
        raise ValidationError(f"Unknown result kind: {kind!r}")
    result_id = uuid.uuid4().hex
    rows = json_records(result).select(
        F.lit(session_id).alias("session_id"),
        F.lit(result_id).alias("result_id"),
        F.lit(datetime.now(UTC).isoformat()).alias("created_at"),
        F.lit(json.dumps(spec, default=str, sort_keys=True)).alias("spec"),
        F.monotonically_increasing_id().alias("position"),
        F.col("json").alias("result"),
        F.lit(kind).alias("kind"),
    )
    rows.write.mode("append").partitionBy("kind").parquet(path)
    return result_id


def session_results(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """All logged results of one session in the order they were made."""
    return (
        spark.read.parquet(path).where(F.col("session_id") == session_id)
        .orderBy("created_at", "result_id", "position")
    )


def cached_profile(df: DataFrame, path: str, dataset_id: str, refresh: bool = False) -> tuple[Profile, bool]:
    """(profile, whether it came from the cache); a refresh replaces only this table's entry."""
    spark = df.sparkSession
    if not refresh:
        try:
            row = spark.read.parquet(path).where(F.col("dataset_id") == dataset_id).select("payload").first()
        except AnalysisException:  # no cache yet
            row = None
        if row is not None:
            saved = json.loads(row["payload"])
            return Profile(spark, saved["columns"], saved["issues"], saved["summary"]), True
    fresh = profile(df)
    payload = json.dumps({"columns": fresh.columns, "issues": fresh.issues, "summary": fresh.summary})
    entry = [(payload, fresh.summary["quality"]["overall"], datetime.now(UTC).isoformat(), dataset_id)]
    (
        spark.createDataFrame(entry, "payload string, quality_score int, generated_at string, dataset_id string")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)
    )
    return fresh, False


def write_report(report: DataFrame, path: str) -> None:
    """Store a report record as a JSON document."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
