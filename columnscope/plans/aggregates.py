"""Grouping and every aggregation."""

from __future__ import annotations

from columnscope.operators.counting import duplicate_rows, value_counts
from columnscope.operators.charts import top_n_with_other
from columnscope.operators.query import aggregate, run_query
from columnscope.plans.base import CUSTOMER_WITH_GAPS, customer_with_gaps, rounded, table

GAPS = f"FROM ({CUSTOMER_WITH_GAPS}) g"


def _by_flag(*metrics, digits=2):
    specs = [dict(aggregation=a, column=c) for a, c in metrics]
    return lambda spark, folder: rounded(run_query(
        table(spark, folder, "lineitem"), group_by=["l_returnflag", "l_linestatus"], metrics=specs
    ), digits)


def _flag_sql(select: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, {select} FROM lineitem GROUP BY ALL"


def _gap_groups(*metrics, digits=2):
    specs = [dict(aggregation=a, column=c) for a, c in metrics]
    return lambda spark, folder: rounded(run_query(
        customer_with_gaps(spark, folder), group_by=["segment", "c_nationkey"], metrics=specs
    ), digits)


ENTRIES = {
    "agg_sum": (
        _by_flag(("sum", "l_extendedprice"), ("sum", "l_linenumber")),
        _flag_sql("round(sum(l_extendedprice), 2) AS sum_l_extendedprice, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber"),
    ),
    "agg_sum_of_missing": (
        _gap_groups(("sum", "balance"), ("mean", "balance"), ("count", "balance"), digits=6),
        "SELECT segment, c_nationkey, round(coalesce(sum(balance), 0), 6) AS sum_balance, "
        f"round(avg(balance), 6) AS mean_balance, count(balance) AS count_balance {GAPS} GROUP BY ALL",
    ),
    "agg_mean": (_by_flag(("mean", "l_quantity")), _flag_sql("round(avg(l_quantity), 2) AS mean_l_quantity")),
    "agg_median": (
        _by_flag(("median", "l_extendedprice"), ("median", "l_quantity"), digits=3),
        _flag_sql("round(median(l_extendedprice), 3) AS median_l_extendedprice, median(l_quantity) AS median_l_quantity"),
    ),
    "agg_median_of_missing": (
        _gap_groups(("median", "balance"), ("count", None), digits=3),
        "SELECT segment, c_nationkey, round(median(balance), 3) AS median_balance, count(*) AS count "
        f"{GAPS} GROUP BY ALL",
    ),
    "agg_count": (
        _by_flag(("count", None), ("count", "l_tax")), _flag_sql("count(*) AS count, count(l_tax) AS count_l_tax")
    ),
    "agg_min": (
        _by_flag(("min", "l_extendedprice"), ("min", "l_shipdate")),
        _flag_sql("round(min(l_extendedprice), 2) AS min_l_extendedprice, min(l_shipdate) AS min_l_shipdate"),
    ),
    "agg_max": (
        _by_flag(("max", "l_extendedprice"), ("max", "l_shipdate")),
        _flag_sql("round(max(l_extendedprice), 2) AS max_l_extendedprice, max(l_shipdate) AS max_l_shipdate"),
    ),
    "agg_std": (_by_flag(("std", "l_extendedprice")), _flag_sql("round(stddev_samp(l_extendedprice), 2) AS std_l_extendedprice")),
    "agg_std_single_row": (
        lambda spark, folder: rounded(run_query(
            table(spark, folder, "nation"), group_by=["n_nationkey"],
            metrics=[dict(aggregation="std", column="n_regionkey", alias="spread")],
        )),
        "SELECT n_nationkey, stddev_samp(n_regionkey) AS spread FROM nation GROUP BY ALL",
    ),
    "agg_global": (
        lambda spark, folder: rounded(run_query(table(spark, folder, "orders"), metrics=[
            dict(aggregation="count"), dict(aggregation="mean", column="o_totalprice", alias="avg_price"),
            dict(aggregation="median", column="o_totalprice"), dict(aggregation="max", column="o_orderdate"),
        ]), 3),
        "SELECT count(*) AS count, round(avg(o_totalprice), 3) AS avg_price, round(median(o_totalprice), 3) AS "
        "median_o_totalprice, max(o_orderdate) AS max_o_orderdate FROM orders",
    ),
    "agg_multi": (
        lambda spark, folder: rounded(run_query(
            table(spark, folder, "orders"), group_by=["o_orderpriority"], metrics=[
                dict(aggregation="sum", column="o_totalprice", alias="revenue"), dict(aggregation="count"),
                dict(aggregation="std", column="o_totalprice", alias="spread"),
                dict(aggregation="median", column="o_totalprice", alias="middle"),
            ], sort=dict(by="revenue"), limit=3,
        ), 3),
        "SELECT o_orderpriority, round(sum(o_totalprice), 3) AS revenue, count(*) AS count, "
        "round(stddev_samp(o_totalprice), 3) AS spread, round(median(o_totalprice), 3) AS middle FROM orders "
        "GROUP BY ALL ORDER BY sum(o_totalprice) DESC LIMIT 3",
    ),
    "agg_default_count": (
        lambda spark, folder: run_query(table(spark, folder, "events"), group_by=["event_type"]),
        "SELECT event_type, count(*) AS count FROM events GROUP BY ALL",
    ),
    "agg_null_key": (
        lambda spark, folder: run_query(customer_with_gaps(spark, folder), group_by=["segment"]),
        f"SELECT segment, count(*) AS count {GAPS} GROUP BY ALL",
    ),
    "agg_text_min_max": (
        lambda spark, folder: run_query(table(spark, folder, "customer"), group_by=["c_nationkey"], metrics=[
            dict(aggregation="min", column="c_name"), dict(aggregation="max", column="c_mktsegment"),
        ]),
        "SELECT c_nationkey, min(c_name) AS min_c_name, max(c_mktsegment) AS max_c_mktsegment FROM customer GROUP BY ALL",
    ),
    "distinct_counts": (
        lambda spark, folder: value_counts(table(spark, folder, "lineitem")).groupBy("pos").count()
        .selectExpr("pos", "count as distinct_values"),
        " UNION ALL ".join(
            f"SELECT {i} AS pos, count(DISTINCT {c}) AS distinct_values FROM lineitem"
            for i, c in enumerate([
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
            ])
        ),
    ),
    "duplicate_rows": (
        lambda spark, folder: duplicate_rows(table(spark, folder, "lineitem").selectExpr(
            "l_quantity", "l_discount", "nullif(l_returnflag, 'R') as flag", "l_linestatus"
        )),
        "SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, "
        "nullif(l_returnflag, 'R') AS flag, l_linestatus FROM lineitem)) AS duplicate_rows FROM lineitem",
    ),
    "duplicate_texts": (
        lambda spark, folder: duplicate_rows(table(spark, folder, "documents").select("text")),
        "SELECT count(*) AS row_count, count(*) - count(DISTINCT text) AS duplicate_rows FROM documents",
    ),
    "top_n_other": (
        lambda spark, folder: rounded(top_n_with_other(
            aggregate(table(spark, folder, "part"), ["p_brand"], [
                dict(aggregation="sum", column="p_retailprice", alias="value"),
            ]), "p_brand", "value", 8,
        ), 2),
        "WITH g AS (SELECT p_brand, sum(p_retailprice) AS value FROM part GROUP BY p_brand), r AS (SELECT *, "
        "row_number() OVER (ORDER BY value DESC, p_brand) AS k FROM g) SELECT CASE WHEN k < 8 THEN p_brand ELSE 'Other' "
        "END AS p_brand, round(sum(value), 2) AS value FROM r GROUP BY 1",
    ),
}
