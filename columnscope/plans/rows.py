"""Filters, search, paging, sorting, limits."""

from __future__ import annotations

from columnscope.operators.query import (
    apply_filters, preview, preview_info, query_summary, run_query, search_rows, trim_arrays,
)
from columnscope.plans.base import CUSTOMER_WITH_GAPS, customer_with_gaps, table

GAPS = f"FROM ({CUSTOMER_WITH_GAPS}) g"
ALL = "SELECT c_custkey, c_name, segment, balance, c_nationkey "


def _gaps(*filters):
    specs = [dict(column=c, operator=o, value=v) for c, o, v in filters]
    return lambda spark, folder: apply_filters(customer_with_gaps(spark, folder), specs)


def _lineitem(*filters):
    specs = [dict(column=c, operator=o, value=v) for c, o, v in filters]
    return lambda spark, folder: apply_filters(table(spark, folder, "lineitem"), specs)


LINE = "SELECT * FROM lineitem WHERE "

ENTRIES = {
    "filter_eq": (_gaps(("segment", "eq", "MACHINERY")), f"{ALL} {GAPS} WHERE segment = 'MACHINERY'"),
    "filter_ne": (_gaps(("segment", "ne", "MACHINERY")), f"{ALL} {GAPS} WHERE segment IS DISTINCT FROM 'MACHINERY'"),
    "filter_ne_number": (
        _gaps(("balance", "ne", 1863.84)), f"{ALL} {GAPS} WHERE balance IS DISTINCT FROM CAST(1863.84 AS DOUBLE)"
    ),
    "filter_gt": (_gaps(("balance", "gt", "5000")), f"{ALL} {GAPS} WHERE balance > 5000"),
    "filter_gte_integer": (_gaps(("c_nationkey", "gte", 19.5)), f"{ALL} {GAPS} WHERE c_nationkey >= 19.5"),
    "filter_lt": (_gaps(("balance", "lt", 0)), f"{ALL} {GAPS} WHERE balance < 0"),
    "filter_lte": (_gaps(("balance", "lte", 100.5)), f"{ALL} {GAPS} WHERE balance <= 100.5"),
    "filter_in": (
        _gaps(("segment", "in", ["MACHINERY", "HOUSEHOLD"])), f"{ALL} {GAPS} WHERE segment IN ('MACHINERY', 'HOUSEHOLD')"
    ),
    "filter_in_with_null": (
        _gaps(("segment", "in", ["MACHINERY", None])), f"{ALL} {GAPS} WHERE segment = 'MACHINERY' OR segment IS NULL"
    ),
    "filter_not_in": (
        _gaps(("segment", "not_in", ["MACHINERY", "HOUSEHOLD"])),
        f"{ALL} {GAPS} WHERE NOT coalesce(segment IN ('MACHINERY', 'HOUSEHOLD'), FALSE)",
    ),
    "filter_contains": (_gaps(("segment", "contains", "hin")), f"{ALL} {GAPS} WHERE contains(lower(segment), 'hin')"),
    "filter_contains_text": (
        lambda spark, folder: apply_filters(
            table(spark, folder, "documents"), [dict(column="text", operator="contains", value="THE")]
        ).select("doc_id", "lang"),
        "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the')",
    ),
    "filter_is_null": (_gaps(("balance", "is_null", None)), f"{ALL} {GAPS} WHERE balance IS NULL"),
    "filter_not_null": (_gaps(("segment", "not_null", None)), f"{ALL} {GAPS} WHERE segment IS NOT NULL"),
    "filter_date_from": (
        _lineitem(("l_shipdate", "gte", "2000-06-01"), ("l_quantity", "gt", 45)),
        LINE + "l_shipdate >= TIMESTAMP '2000-06-01' AND l_quantity > 45",
    ),
    "filter_date_equals": (
        _lineitem(("l_shipdate", "eq", "1998-03-05")), LINE + "l_shipdate = TIMESTAMP '1998-03-05'"
    ),
    "filter_and_combined": (
        _lineitem(("l_returnflag", "in", ["A", "R"]), ("l_discount", "lt", "0.03"), ("l_linenumber", "ne", 1)),
        LINE + "l_returnflag IN ('A', 'R') AND l_discount < CAST(0.03 AS DOUBLE) AND l_linenumber <> 1",
    ),
    "search_rows": (
        lambda spark, folder: search_rows(table(spark, folder, "part"), "Brand#1"),
        "SELECT * FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1') "
        "OR contains(lower(p_type), 'brand#1')",
    ),
    "raw_rows": (
        lambda spark, folder: run_query(
            table(spark, folder, "orders"), filters=[dict(column="o_orderstatus", operator="eq", value="F")]
        ),
        "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey, o_custkey LIMIT 1000",
    ),
    "sort_nulls_last_asc": (
        lambda spark, folder: run_query(
            customer_with_gaps(spark, folder).select("c_custkey", "balance"),
            sort=dict(by="balance", direction="asc"), limit=5000,
        ),
        f"SELECT c_custkey, balance {GAPS} ORDER BY balance ASC NULLS LAST, c_custkey LIMIT 5000",
    ),
    "sort_nulls_last_desc": (
        lambda spark, folder: run_query(
            customer_with_gaps(spark, folder).select("c_custkey", "segment"), sort=dict(by="segment"), limit=700
        ),
        f"SELECT c_custkey, segment {GAPS} ORDER BY segment DESC NULLS LAST, c_custkey LIMIT 700",
    ),
    "top_k": (
        lambda spark, folder: run_query(table(spark, folder, "orders"), sort=dict(by="o_totalprice"), limit=10),
        "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey, o_custkey LIMIT 10",
    ),
    "query_summary": (
        lambda spark, folder: query_summary(
            table(spark, folder, "lineitem"), filters=[dict(column="l_quantity", operator="gt", value=10)]
        ),
        "SELECT least(count(*), 1000) AS row_count, count(*) AS total_matched_rows, count(*) > 1000 AS truncated "
        "FROM lineitem WHERE l_quantity > 10",
    ),
    "query_summary_grouped": (
        lambda spark, folder: query_summary(table(spark, folder, "orders"), group_by=["o_custkey"], limit=100),
        "SELECT least(count(*), 100) AS row_count, count(*) AS total_matched_rows, count(*) > 100 AS truncated "
        "FROM (SELECT DISTINCT o_custkey FROM orders)",
    ),
    "preview_page": (
        lambda spark, folder: preview(table(spark, folder, "part"), page=3, page_size=25, sort="p_size", sort_dir="desc"),
        "SELECT * FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 25 OFFSET 50",
    ),
    "preview_search": (
        lambda spark, folder: preview(table(spark, folder, "part"), page=2, page_size=20, search="ECONOMY"),
        "SELECT * FROM part WHERE contains(lower(p_name), 'economy') OR contains(lower(p_brand), 'economy') "
        "OR contains(lower(p_type), 'economy') ORDER BY p_partkey LIMIT 20 OFFSET 20",
    ),
    **{
        f"preview_deep_{name}": (
            lambda spark, folder, sort=sort, direction=direction, page=page: preview(
                table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag"),
                page=page, page_size=50, sort=sort, sort_dir=direction,
            ),
            f"SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem ORDER BY {sort} {direction} NULLS LAST, "
            + ", ".join(c for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag") if c != sort)
            + f" LIMIT 50 OFFSET {(page - 1) * 50}",
        )
        for name, sort, direction, page in (("number", "l_quantity", "desc", 900), ("text", "l_returnflag", "asc", 1001), ("date", "l_shipdate", "asc", 612))
    },
    "preview_info": (
        lambda spark, folder: preview_info(table(spark, folder, "orders"), page=2, page_size=40),
        "SELECT 2 AS page, 40 AS page_size, count(*) AS total_rows, CAST(ceil(count(*) / 40.0) AS BIGINT) AS total_pages "
        "FROM orders",
    ),
    "trim_arrays": (
        lambda spark, folder: trim_arrays(table(spark, folder, "embeddings").select("vec_id", "embedding")).selectExpr(
            "vec_id", "embedding_cut", "size(embedding) as kept", "round(cast(embedding[19] as double), 5) as last_kept"
        ),
        "SELECT vec_id, CAST(greatest(len(embedding) - 20, 0) AS INTEGER) AS embedding_cut, "
        "CAST(least(len(embedding), 20) AS INTEGER) AS kept, round(CAST(embedding[20] AS DOUBLE), 5) AS last_kept "
        "FROM embeddings",
    ),
}
