"""The SQL entry point: each text runs as it is on both engines, over the table called ``dataset``."""

from __future__ import annotations

import re

from columnscope.operators.asof import asof_join
from columnscope.operators.sql import run_sql, sql_summary
from columnscope.plans.base import rounded, table

TEXTS = {
    "sql_select": (
        "orders", "SELECT o_orderkey, upper(o_orderstatus) AS status, o_totalprice * 2 AS doubled FROM dataset "
        "WHERE o_totalprice > 495000 AND o_orderpriority LIKE '%HIGH'",
    ),
    "sql_group": (
        "lineitem", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM dataset "
        "GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 ORDER BY quantity DESC LIMIT 5",
    ),
    "sql_cte": (
        "orders", "WITH per AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM dataset GROUP BY o_custkey) "
        "SELECT count(*) AS customers, round(avg(spent), 2) AS average FROM per WHERE spent > 100000",
    ),
    "sql_recursive": (
        "nation", "WITH RECURSIVE k(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM k WHERE n < 25) SELECT k.n, n_name "
        "FROM k LEFT JOIN dataset ON n_nationkey = k.n",
    ),
    "sql_join": (
        "supplier", "SELECT a.s_nationkey AS nation, count(*) AS pairs, round(max(b.s_acctbal), 2) AS best FROM dataset a "
        "JOIN dataset b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY a.s_nationkey",
    ),
    "sql_outer_join": (
        "nation", "SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM dataset a FULL OUTER JOIN dataset b "
        "ON a.n_nationkey = b.n_nationkey + 10",
    ),
    "sql_theta_join": (
        "nation", "SELECT a.n_nationkey AS k, count(b.n_nationkey) AS smaller FROM dataset a LEFT JOIN dataset b "
        "ON b.n_nationkey < a.n_nationkey AND b.n_regionkey <> a.n_regionkey GROUP BY a.n_nationkey",
    ),
    "sql_semi_anti": (
        "orders", "SELECT o_orderstatus, count(*) AS n FROM dataset d WHERE EXISTS (SELECT 1 FROM dataset e WHERE "
        "e.o_custkey = d.o_custkey AND e.o_orderpriority = '1-URGENT') AND o_custkey NOT IN (SELECT o_custkey FROM dataset "
        "WHERE o_totalprice > 499000) GROUP BY o_orderstatus",
    ),
    "sql_setops": (
        "orders", "SELECT o_custkey FROM dataset WHERE o_totalprice > 480000 INTERSECT SELECT o_custkey FROM dataset WHERE "
        "o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM dataset WHERE o_orderpriority = '5-LOW' UNION ALL "
        "SELECT min(o_custkey) FROM dataset",
    ),
    "sql_ranking_windows": (
        "customer", "SELECT * FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY "
        "c_acctbal DESC, c_custkey) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d, "
        "rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS k FROM dataset) t WHERE r <= 20",
    ),
    "sql_analytic_windows": (
        "events", "SELECT user_id, max(gap) AS longest, count(earlier) AS followed FROM (SELECT user_id, value - lag(value) "
        "OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, "
        "event_id) AS earlier FROM dataset) t GROUP BY user_id ORDER BY user_id LIMIT 1000",
    ),
    "sql_frames": (
        "nation", "SELECT n_nationkey, sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) "
        "AS three, count(*) OVER (ORDER BY n_regionkey RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS near FROM dataset",
    ),
    "sql_grouping_sets": (
        "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, "
        "count(*) FILTER (WHERE o_totalprice > 250000) AS large FROM dataset GROUP BY GROUPING SETS "
        "((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    ),
    "sql_cube": (
        "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM dataset GROUP BY CUBE (l_returnflag, l_linestatus)",
    ),
    "sql_case_subquery": (
        "part", "SELECT CASE WHEN p_retailprice > (SELECT avg(p_retailprice) FROM dataset) THEN 'above' ELSE 'below' END "
        "AS side, count(*) AS n, max(p_size) AS largest FROM dataset GROUP BY 1",
    ),
}


def _query(name, text):
    return lambda spark, folder: rounded(run_sql(table(spark, folder, name), text), 2)


def _oracle(name: str, text: str) -> str:
    doubles = {"doubled": "round({}, 2)"}
    body = re.sub(r"\bdataset\b", name, text)
    for alias, shape in doubles.items():
        body = body.replace("o_totalprice * 2 AS doubled", shape.format("o_totalprice * 2") + f" AS {alias}")
    body = body.replace("max(gap) AS longest", "round(max(gap), 2) AS longest")
    body = body.replace("sum(l_quantity) AS quantity", "round(sum(l_quantity), 2) AS quantity")
    return re.sub(r"\bsum\(n_nationkey\) OVER (\([^)]*\))", r"CAST(sum(n_nationkey) OVER \1 AS BIGINT)", body)


ENTRIES = {name: (_query(t, text), _oracle(t, text)) for name, (t, text) in TEXTS.items()} | {
    "asof_join": (
        lambda spark, folder: rounded(asof_join(
            table(spark, folder, "events").where("event_type = 'click'").select("event_id", "user_id", "ts"),
            table(spark, folder, "events").where("event_type = 'view'").select("user_id", "ts", "value"),
            "ts", "ts", ["user_id"], ["value"],
        ).select("event_id", "user_id", "matched_value"), 3),
        "SELECT a.event_id, a.user_id, round(b.value, 3) AS matched_value FROM (SELECT * FROM events WHERE event_type = "
        "'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts",
    ),
    "sql_row_cap": (
        lambda spark, folder: run_sql(
            table(spark, folder, "lineitem"),
            "SELECT l_orderkey, l_partkey, l_linenumber FROM dataset ORDER BY l_orderkey, l_partkey, l_linenumber",
        ),
        "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_partkey, l_linenumber LIMIT 1000",
    ),
    "sql_summary": (
        lambda spark, folder: sql_summary(table(spark, folder, "lineitem"), "SELECT DISTINCT l_orderkey FROM dataset"),
        "SELECT least(count(*), 1000) AS row_count, count(*) AS total_matched_rows, count(*) > 1000 AS truncated "
        "FROM (SELECT DISTINCT l_orderkey FROM lineitem)",
    ),
}
