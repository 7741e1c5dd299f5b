"""The report record: profile, statistics, chart data, anomalies and recommendations of one table."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import ref
from columnscope.operators.charts import heatmap, histogram
from columnscope.operators.conversation import latest_assistant_message
from columnscope.operators.outliers import outlier_rows, outlier_summary
from columnscope.operators.profile import COLUMN_SCHEMA, ISSUE_SCHEMA, SUMMARY_SCHEMA, Profile, profile
from columnscope.operators.timeseries import bucketed_series, time_span
from columnscope.sources.results import json_safe

MAX_CHARTS = 4
HISTOGRAM_BINS = 20
TOP_BARS = 8
HEATMAP_COLUMNS = 8
ANOMALY_COLUMNS = 3
ANOMALY_ROWS = 5
MAX_RECOMMENDATIONS = 8
GOOD_SCORE = 90

# What to do about an issue, by its type.
RECOMMENDATIONS = {
    "missing_values": "Decide how '{column}' is to be filled or left out: {message}",
    "duplicate_rows": "Check where the repeated rows come from: {message}",
    "extreme_outliers": "Look at the extreme values of '{column}' and keep only those that are real: {message}",
    "constant_column": "Leave '{column}' out of models and charts; all its values are the same.",
    "high_cardinality_categorical": "Gather the rare values of '{column}' into one group before it is charted or modelled.",
    "invalid_dates": "Correct the values of '{column}' that are not dates.",
}
GOOD_SHAPE = "Nothing needs to be done: no issue was found that would distort an analysis."

METHODOLOGY = (
    "The quality score is the mean of five sub-scores from 0 to 10 (completeness, missing values, duplicates, data "
    "types, outliers) on a scale of 100. Column types follow from the stored type and the values. Outliers lie more "
    "than 1.5 interquartile ranges beyond a quartile; correlations are Pearson coefficients. Every number is "
    "computed from all rows of the table."
)
LIMITATIONS = (
    "The report describes the table as it was when the report was made. Outliers and correlations use one method "
    "each, and charts show a selection of the columns. A quoted assistant message is the newest stored one; it was "
    "not written for this report."
)

_REPORT_SCHEMA = (
    "dataset struct<name:string,row_count:bigint,column_count:int,size_bytes:bigint>, executive_summary string, "
    f"summary {SUMMARY_SCHEMA.simpleString()}, columns array<{COLUMN_SCHEMA.simpleString()}>, "
    f"issues array<{ISSUE_SCHEMA.simpleString()}>, "
    "numeric_stats array<string>, categorical_stats array<string>, "
    "charts array<struct<title:string,kind:string,labels:array<string>,values:array<double>>>, "
    "anomalies array<struct<column:string,method:string,outlier_count:bigint,outlier_percentage:double,"
    "sample_rows:array<string>>>, recommendations array<string>, assistant_message string, "
    "methodology string, limitations string, generated_at string"
)


def executive_summary(found: Profile, name: str, size_bytes: int) -> str:
    """The table's size, quality and gaps in four short statements."""
    s = found.summary
    facts = {
        "Rows": f"{s['row_count']:,}", "columns": s["column_count"], "bytes": f"{size_bytes:,}",
        "quality": f"{s['quality']['overall']} of 100", "empty cells": f"{s['missing_percentage']} %",
        "repeated rows": f"{s['duplicate_rows']:,}", "issues": len(found.issues),
    }
    return f"{name} - " + ", ".join(f"{k}: {v}" for k, v in facts.items()) + "."


def recommendation_list(found: Profile) -> list[str]:
    texts = [RECOMMENDATIONS[i["type"]].format(**i) for i in found.issues if i["type"] in RECOMMENDATIONS]
    if not texts and found.summary["quality"]["overall"] >= GOOD_SCORE:
        texts.append(GOOD_SHAPE)
    return texts[:MAX_RECOMMENDATIONS]


def recommendations(found: Profile) -> DataFrame:
    rows = list(enumerate(recommendation_list(found)))
    return found.spark.createDataFrame(rows, "position int, recommendation string")


def report_charts(df: DataFrame, found: Profile) -> list[dict[str, Any]]:
    """Up to four small chart datasets."""
    measures, dates, categories = found.measures(), found.dates(), found.categories()
    charts: list[dict[str, Any]] = []

    def add(title: str, kind: str, pairs: list[tuple[Any, Any]]) -> None:
        charts.append({
            "title": title, "kind": kind, "labels": [str(a) for a, _ in pairs],
            "values": [None if b is None else float(b) for _, b in pairs],
        })

    if measures:
        try:
            bins = histogram(df, measures[0], HISTOGRAM_BINS).orderBy("bin").collect()
            add(f"Distribution of {measures[0]}", "histogram", [(r["bin_start"], r["count"]) for r in bins])
        except ValidationError:
            pass
    if categories:
        top = categories[0]["categorical"]["top_categories"][:TOP_BARS]
        add(f"Top categories in {categories[0]['name']}", "bar", [(t["value"], t["count"]) for t in top])
    if dates and measures and time_span(df, dates[0]) is not None:
        series = bucketed_series(df, dates[0], measures[0]).orderBy("bucket").collect()
        if len(series) >= 2:
            add(f"{measures[0]} over time", "line", [(r["bucket"].date(), r["value"]) for r in series])
    if len(measures) >= 2:
        cells = heatmap(df, measures[:HEATMAP_COLUMNS]).collect()
        add("Correlation heatmap", "heatmap", [(f"{r[0]} / {r[1]}", r[2]) for r in cells])
    return charts[:MAX_CHARTS]


def report_anomalies(df: DataFrame, found: Profile) -> list[dict[str, Any]]:
    """IQR outliers of the first measures, with a few full rows each."""
    names = found.measures()[:ANOMALY_COLUMNS]
    if not names:
        return []
    extreme = outlier_rows(df, names, limit=ANOMALY_ROWS)
    row = F.struct(*[ref(c) for c in df.columns])
    shown = json_safe(extreme).select(
        "outlier_column", "rank", F.to_json(row, {"ignoreNullFields": "false"}).alias("json")
    ).collect()
    samples: dict[str, list] = {}
    for row in sorted(shown, key=lambda r: r["rank"]):
        samples.setdefault(row["outlier_column"], []).append(row["json"])
    return [
        row.asDict() | {"sample_rows": samples.get(row["column"], [])} for row in outlier_summary(df, names).collect()
    ]


def report(
    df: DataFrame, name: str, size_bytes: int = 0, messages: DataFrame | None = None, found: Profile | None = None
) -> DataFrame:
    """One row holding the whole report; ``messages`` is a conversation log."""
    found = found or profile(df)
    said = latest_assistant_message(messages).first() if messages is not None else None
    s = found.summary
    record = {
        "dataset": {"name": name, "row_count": s["row_count"], "column_count": s["column_count"], "size_bytes": size_bytes},
        "executive_summary": executive_summary(found, name, size_bytes),
        "summary": s,
        "columns": found.columns,
        "issues": found.issues,
        "numeric_stats": [c["name"] for c in found.columns if c["numeric"] is not None],
        "categorical_stats": [c["name"] for c in found.categories()],
        "charts": report_charts(df, found),
        "anomalies": report_anomalies(df, found),
        "recommendations": recommendation_list(found),
        "assistant_message": said["text"] if said else None,
        "methodology": METHODOLOGY,
        "limitations": LIMITATIONS,
        "generated_at": datetime.now(UTC).isoformat(),
    }
    return df.sparkSession.createDataFrame([record], _REPORT_SCHEMA)
