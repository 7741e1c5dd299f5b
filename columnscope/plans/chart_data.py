"""Chart datasets and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnscope.operators.charts import chart_data, scatter_summary
from columnscope.operators.profile import profile
from columnscope.operators.suggest import build_suggested_charts, suggest_charts, suggest_tasks
from columnscope.plans.base import CUSTOMER_WITH_GAPS, customer_with_gaps, dated, rounded, table

GAPS = f"({CUSTOMER_WITH_GAPS})"


def _chart(name, digits=2, **request):
    return lambda spark, folder: rounded(chart_data(table(spark, folder, name), **request), digits)


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return (
        f"WITH e AS (SELECT min({column}) AS low, (max({column}) - min({column})) / {bins} AS w FROM {source} t), "
        f"c AS (SELECT least(floor(({column} - low) / w), {bins - 1}) AS bin, count(*) AS n FROM {source} t, e "
        f"WHERE {column} IS NOT NULL GROUP BY 1) SELECT CAST(k AS INTEGER) AS bin, round(low + k * w, 2) AS bin_start, "
        f"round(low + (k + 1) * w, 2) AS bin_end, coalesce(n, 0) AS count FROM e, range({bins}) r(k) LEFT JOIN c ON bin = k"
    )


def _box_sql(source: str, y: str, group: str, keep: str = "TRUE") -> str:
    return (
        f"WITH r AS (SELECT {group} AS g, {y} AS v FROM {source} t WHERE {y} IS NOT NULL AND {keep}), q AS (SELECT g, "
        "quantile_cont(v, 0.25) AS q1, median(v) AS m, quantile_cont(v, 0.75) AS q3 FROM r GROUP BY g), j AS (SELECT r.g, "
        "v, q1, m, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM r JOIN q ON r.g = q.g) "
        'SELECT g AS "group", round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, count(*) AS count, '
        "round(min(v), 4) AS min, round(max(v), 4) AS max, round(min(v) FILTER (WHERE inside), 4) AS whisker_low, "
        "round(max(v) FILTER (WHERE inside), 4) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers "
        "FROM j GROUP BY g, q1, m, q3"
    )


def _folded_sql(category: str, value: str, source: str, n: int) -> str:
    return (
        f"WITH g AS (SELECT {category} AS c, {value} AS v FROM {source} GROUP BY 1), r AS (SELECT *, row_number() OVER "
        f"(ORDER BY v DESC NULLS LAST, c) AS k, count(*) OVER () AS t FROM g) SELECT CASE WHEN k < {n} OR t <= {n} "
        f"THEN c ELSE 'Other' END AS category, round(sum(v), 2) AS value FROM r GROUP BY 1"
    )


MONTH = "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"

# Orders have two measures, two small categories and a date, whatever the size; the numbers of groups are counted.
SUGGESTED_SQL = """
WITH n AS (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders)
SELECT 0 AS position, 'histogram' AS chart_type, 'o_custkey' AS x, NULL AS y, NULL AS aggregation, NULL AS columns,
       'Spread of o_custkey' AS title, 'Shows where the values of o_custkey lie.' AS reason
UNION ALL SELECT 1, 'histogram', 'o_totalprice', NULL, NULL, NULL, 'Spread of o_totalprice', 'Shows where the values of o_totalprice lie.'
UNION ALL SELECT 2, 'bar', 'o_orderstatus', 'o_custkey', 'sum', NULL, 'Sum of o_custkey for each o_orderstatus', 'o_orderstatus splits the rows into ' || s || ' groups.' FROM n
UNION ALL SELECT 3, 'bar', 'o_orderpriority', 'o_custkey', 'sum', NULL, 'Sum of o_custkey for each o_orderpriority', 'o_orderpriority splits the rows into ' || p || ' groups.' FROM n
UNION ALL SELECT 4, 'line', 'o_orderdate', 'o_custkey', 'sum', NULL, 'o_custkey by o_orderdate', 'Follows o_custkey along o_orderdate.'
UNION ALL SELECT 5, 'line', 'o_orderdate', 'o_totalprice', 'sum', NULL, 'o_totalprice by o_orderdate', 'Follows o_totalprice along o_orderdate.'
UNION ALL SELECT 6, 'heatmap', NULL, NULL, NULL, 'o_custkey,o_totalprice', 'How the measures move together', 'Compares 2 measures in pairs.'"""

TASKS_SQL = """
WITH n AS (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders)
SELECT 0 AS position, 'classification' AS task, 'o_orderstatus' AS target, 'o_custkey,o_totalprice,o_orderpriority' AS features,
       'Learns which of ' || s || ' classes of o_orderstatus a row belongs to.' AS reason FROM n
UNION ALL SELECT 1, 'classification', 'o_orderpriority', 'o_custkey,o_orderstatus,o_totalprice', 'Learns which of ' || p || ' classes of o_orderpriority a row belongs to.' FROM n
UNION ALL SELECT 2, 'regression', 'o_custkey', 'o_orderstatus,o_totalprice,o_orderpriority', 'Learns to estimate o_custkey.'
UNION ALL SELECT 3, 'regression', 'o_totalprice', 'o_custkey,o_orderstatus,o_orderpriority', 'Learns to estimate o_totalprice.'
UNION ALL SELECT 4, 'clustering', NULL, 'o_custkey,o_totalprice', 'Finds groups of rows alike in 2 measures.'
UNION ALL SELECT 5, 'anomaly_detection', NULL, 'o_custkey,o_totalprice', 'Finds rows that stand apart in their measures.'"""

ENTRIES = {
    "chart_histogram": (
        lambda spark, folder: rounded(chart_data(table(spark, folder, "orders"), "histogram", x="o_totalprice"), 2),
        _histogram_sql("orders", "o_totalprice", 30),
    ),
    "chart_histogram_gaps": (
        lambda spark, folder: rounded(chart_data(customer_with_gaps(spark, folder), "histogram", x="balance", bins=12), 2),
        _histogram_sql(GAPS, "balance", 12),
    ),
    "chart_box": (
        _chart("orders", digits=4, chart_type="box", x="o_orderpriority", y="o_totalprice"),
        _box_sql("orders", "o_totalprice", "o_orderpriority"),
    ),
    "chart_box_whole": (
        lambda spark, folder: rounded(chart_data(
            table(spark, folder, "events").selectExpr("value * value * value as cubed"), "box", y="cubed"
        ), 4),
        _box_sql("(SELECT value * value * value AS cubed FROM events)", "cubed", "'cubed'"),
    ),
    "chart_bar": (
        _chart("part", chart_type="bar", x="p_brand", y="p_retailprice"),
        _folded_sql("p_brand", "sum(p_retailprice)", "part", 20),
    ),
    "chart_bar_null_category": (
        lambda spark, folder: rounded(chart_data(
            customer_with_gaps(spark, folder), "bar", x="segment", y="balance", aggregation="mean"
        ), 2),
        f"SELECT segment AS category, round(avg(balance), 2) AS value FROM {GAPS} t GROUP BY 1",
    ),
    "chart_bar_filtered": (
        _chart("lineitem", chart_type="bar", x="l_returnflag", filters=[dict(column="l_quantity", operator="gt", value=25)]),
        "SELECT l_returnflag AS category, count(*) AS value FROM lineitem WHERE l_quantity > 25 GROUP BY 1",
    ),
    "chart_grouped_bar": (
        _chart("orders", chart_type="grouped_bar", x="o_orderpriority", group_by="o_orderstatus", y="o_totalprice"),
        "SELECT o_orderstatus AS series, o_orderpriority AS category, round(sum(o_totalprice), 2) AS value FROM orders "
        "GROUP BY ALL",
    ),
    "chart_grouped_bar_null_series": (
        lambda spark, folder: chart_data(
            customer_with_gaps(spark, folder), "grouped_bar", x="c_nationkey", group_by="segment"
        ),
        f"SELECT segment AS series, c_nationkey AS category, count(*) AS value FROM {GAPS} t WHERE segment IS NOT NULL GROUP BY ALL",
    ),
    "chart_pie": (
        _chart("part", chart_type="pie", x="p_brand"), _folded_sql("p_brand", "count(*)", "part", 8)
    ),
    "chart_line": (
        lambda spark, folder: rounded(dated(chart_data(
            table(spark, folder, "orders"), "line", x="o_orderdate", y="o_totalprice"
        ), "bucket"), 2),
        f"SELECT {MONTH} AS bucket, round(sum(o_totalprice), 2) AS value, FALSE AS fill FROM orders GROUP BY 1",
    ),
    "chart_area_series": (
        lambda spark, folder: rounded(dated(chart_data(
            table(spark, folder, "orders"), "area", x="o_orderdate", y="o_totalprice", aggregation="median",
            group_by="o_orderstatus",
        ), "bucket"), 3),
        f"SELECT {MONTH} AS bucket, o_orderstatus AS series, round(median(o_totalprice), 3) AS value, TRUE AS fill "
        "FROM orders GROUP BY 1, 2",
    ),
    "chart_line_unreadable_dates": (
        lambda spark, folder: dated(chart_data(table(spark, folder, "orders").select(
            F.expr("if(o_orderkey % 20 = 0, 'unknown', date_format(o_orderdate, 'yyyy-MM-dd'))").alias("day")
        ), "line", x="day"), "bucket"),
        f"SELECT CASE WHEN o_orderkey % 20 <> 0 THEN {MONTH} END AS bucket, count(*) AS value, FALSE AS fill "
        "FROM orders GROUP BY 1",
    ),
    "chart_scatter": (
        _chart("lineitem", chart_type="scatter", x="l_quantity", y="l_extendedprice", limit=500),
        "SELECT l_quantity AS x, round(l_extendedprice, 2) AS y FROM lineitem ORDER BY l_quantity, l_extendedprice LIMIT 500",
    ),
    "chart_scatter_summary": (
        lambda spark, folder: scatter_summary(customer_with_gaps(spark, folder), "balance", "c_nationkey"),
        f"SELECT least(count(balance), 2000) AS row_count, count(balance) > 2000 AS truncated FROM {GAPS} t",
    ),
    "chart_heatmap": (
        lambda spark, folder: chart_data(table(spark, folder, "events"), "heatmap"),
        " UNION ALL ".join(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, round((SELECT corr({a}, {b}) FROM events), 4) AS correlation"
            for a in ("event_id", "user_id", "value") for b in ("event_id", "user_id", "value")
        ),
    ),
    "suggest_charts": (
        lambda spark, folder: suggest_charts(profile(table(spark, folder, "orders")), table(spark, folder, "orders")).withColumn("columns", F.array_join("columns", ",")),
        SUGGESTED_SQL,
    ),
    "suggested_chart_sizes": (
        lambda spark, folder: spark.createDataFrame([
            (i, s["chart_type"], data.count()) for i, (s, data) in enumerate(build_suggested_charts(
                profile(table(spark, folder, "orders")), table(spark, folder, "orders")
            ))
        ], "position int, chart_type string, data_rows long"),
        """SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS position, unnest(['histogram', 'histogram', 'bar', 'bar', 'line', 'line', 'heatmap']) AS chart_type,
        unnest([30, 30, s, p, m, m, 4]) AS data_rows FROM (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p, count(DISTINCT date_trunc('month', o_orderdate)) AS m FROM orders)""",
    ),
    "suggest_tasks": (
        lambda spark, folder: suggest_tasks(profile(table(spark, folder, "orders"))).withColumn("features", F.array_join("features", ",")),
        TASKS_SQL,
    ),
}
