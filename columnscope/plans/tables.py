"""Sources and sinks, exercised by writing a given table out and reading it back."""

from __future__ import annotations

import math
import uuid

from columnscope.functions.columns import ROW_ID
from columnscope.functions.sizing import estimated_bytes, shared_folder
from columnscope.operators.query import run_query
from columnscope.plans.base import rounded, table
from columnscope.sources.files import check_files, ingest, read_table
from columnscope.sources.results import append_result, cached_profile, json_records, session_results, write_report


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(separator, encoding="UTF-8"):
    def run(spark, folder):
        place = _place(spark, "csv")
        (
            table(spark, folder, "part").write.options(header=True, sep=separator, encoding=encoding, escape='"')
            .csv(f"{place}/in")
        )
        ingest(spark, f"{place}/in", f"{place}/out")
        return read_table(spark, f"{place}/out").drop(ROW_ID)

    return run


# A file of texts to be read by several tasks is made from so much of the (compressed) table.
BREAKS_BYTES = 64 * 1024 * 1024


def _with_breaks(spark, folder):
    """Texts with line breaks, quotes and separators, in files that several tasks read each: one, or more of a large table."""
    place = _place(spark, "breaks")
    rows = table(spark, folder, "documents").selectExpr("doc_id", "lang", "text", "n_chars")
    files = math.ceil((estimated_bytes(rows) or 0) / BREAKS_BYTES)
    rows.coalesce(max(1, files)).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{place}/in")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(256 * 1024))
    try:
        ingest(spark, f"{place}/in", f"{place}/out", multi_line=True)
    finally:
        spark.conf.set(key, before)
    return read_table(spark, f"{place}/out").selectExpr("doc_id", "lang", "md5(text) as text_md5", "length(text) as n", "n_chars")


def _layouts(spark, folder):
    """One table in files of different encodings and separators."""
    place = _place(spark, "layouts")
    people = table(spark, folder, "customer").selectExpr("c_custkey", "concat('é', c_name) as name", "c_acctbal", "c_custkey % 3 as part")
    for part, (separator, encoding) in enumerate(((",", "UTF-8"), (";", "ISO-8859-1"), ("\t", "ISO-8859-1"))):
        people.where(f"part = {part}").drop("part").write.mode("append").options(header=True, sep=separator, encoding=encoding).csv(f"{place}/in")
    ingest(spark, f"{place}/in", f"{place}/out")
    return read_table(spark, f"{place}/out").drop(ROW_ID)


PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def _row_ids(spark, folder):
    place = _place(spark, "rows")
    table(spark, folder, "customer").write.options(header=True).csv(f"{place}/in")
    ingest(spark, f"{place}/in", f"{place}/out")
    return read_table(spark, f"{place}/out").selectExpr(
        "count(*) as n", "count(distinct _row_id) as ids", "min(_row_id) as first_id", "max(_row_id) as last_id"
    )


def _checked(spark, folder):
    return check_files(spark, folder, extensions=("parquet",)).selectExpr(
        "regexp_extract(path, '([^/]+).parquet$', 1) as name", "extension", "accepted"
    )


def _logged(spark, folder):
    place = _place(spark, "log")
    orders = table(spark, folder, "orders")
    request = dict(group_by=["o_orderstatus"], metrics=[dict(aggregation="count")])
    append_result(place, "s1", "table", request, run_query(orders, **request))
    append_result(place, "s2", "table", {}, run_query(orders, group_by=["o_orderpriority"]))
    return session_results(spark, place, "s1").select("session_id", "kind", "result")


def _cached(spark, folder):
    place = _place(spark, "profiles")
    orders = table(spark, folder, "orders")
    _, first = cached_profile(orders, place, "orders")
    found, second = cached_profile(orders, place, "orders")
    return rounded(found.numeric_frame().selectExpr(
        "name", "count", "mean", f"{str(first).lower()} as first_hit", f"{str(second).lower()} as second_hit"
    ))


def _sink(spark, folder):
    place = _place(spark, "report")
    counts = run_query(table(spark, folder, "events"), group_by=["event_type"])
    write_report(counts, place)
    return spark.read.schema("event_type string, count long").json(place)


ENTRIES = {
    "ingest_csv": (_csv(","), PART),
    "ingest_semicolon": (_csv(";"), PART),
    "ingest_tab": (_csv("\t"), PART),
    "ingest_quoted_breaks": (
        _with_breaks,
        "SELECT doc_id, lang, md5(text) AS text_md5, length(text) AS n, n_chars FROM (SELECT doc_id, lang, n_chars, nullif(text, '') AS text FROM documents)",
    ),
    "ingest_latin1": (_csv(",", "ISO-8859-1"), PART),
    "ingest_mixed_layouts": (_layouts, "SELECT c_custkey, 'é' || c_name AS name, c_acctbal FROM customer"),
    "ingest_row_ids": (
        _row_ids,
        "SELECT count(*) AS n, count(*) AS ids, CAST(0 AS BIGINT) AS first_id, count(*) - 1 AS last_id FROM customer",
    ),
    "check_files": (
        _checked,
        " UNION ALL ".join(
            f"SELECT '{n}' AS name, 'parquet' AS extension, TRUE AS accepted FROM (SELECT count(*) AS c FROM {n}) WHERE c > 0"
            for n in (
                "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
                "conversations"
            ).split()
        ),
    ),
    "parquet_scan": (
        lambda spark, folder: read_table(spark, f"{folder}/orders.parquet").select("o_orderkey", "o_totalprice"),
        "SELECT o_orderkey, o_totalprice FROM orders",
    ),
    "json_records": (
        lambda spark, folder: json_records(table(spark, folder, "labels").selectExpr(
            "doc_id", "nullif(quality, 0) as quality", "if(toxic = 1, double('NaN'), 0.5d) as share"
        )),
        "SELECT '{\"doc_id\":' || doc_id || ',\"quality\":' || coalesce(CAST(nullif(quality, 0) AS VARCHAR), 'null') || "
        "',\"share\":' || CASE WHEN toxic = 1 THEN 'null' ELSE '0.5' END || '}' AS json FROM labels",
    ),
    "result_log": (
        _logged,
        "SELECT 's1' AS session_id, 'table' AS kind, '{\"o_orderstatus\":\"' || o_orderstatus || '\",\"count\":' || "
        "count(*) || '}' AS result FROM orders GROUP BY o_orderstatus",
    ),
    "profile_cache": (
        _cached,
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 4) AS mean, FALSE AS first_hit, TRUE AS second_hit "
            "FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice")
        ),
    ),
    "json_sink": (_sink, "SELECT event_type, count(*) AS count FROM events GROUP BY 1"),
}
