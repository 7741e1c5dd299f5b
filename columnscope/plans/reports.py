"""Report record and conversation queries."""

from __future__ import annotations

from columnscope.operators.conversation import conversation_history, latest_assistant_message
from columnscope.operators.profile import profile
from columnscope.operators.report import recommendations, report
from columnscope.plans.base import table


def _report(spark, folder):
    return report(
        table(spark, folder, "orders"), "orders", messages=table(spark, folder, "conversations")
    ).drop("generated_at")


def _recommendations(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("nullif(l_returnflag, 'R') as flag", "'x' as same", "l_tax")
    return recommendations(profile(rows))


ENTRIES = {
    "report_record": (_report, None),
    "recommendations": (
        _recommendations,
        """SELECT 0 AS position, 'Decide how ''flag'' is to be filled or left out: ' || round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 4) || ' % of ''flag'' are empty.' AS recommendation FROM lineitem
        UNION ALL SELECT 1, 'Leave ''same'' out of models and charts; all its values are the same.'
        UNION ALL SELECT 2, 'Check where the repeated rows come from: ' || (n - k) || ' rows (' || round(100.0 * (n - k) / n, 4) || ' %) repeat an earlier one.'
        FROM (SELECT count(*) AS n FROM lineitem), (SELECT count(*) AS k FROM (SELECT DISTINCT nullif(l_returnflag, 'R'), l_tax FROM lineitem))""",
    ),
    "report_facts": (
        lambda spark, folder: _report(spark, folder).selectExpr(
            "dataset.name", "dataset.row_count", "dataset.column_count", "summary.missing_cells", "summary.duplicate_rows", "size(columns) as columns",
            "size(numeric_stats) as numeric_columns", "concat_ws(',', transform(charts, c -> c.kind)) as charts", "columns[3].max_value as last_price", "assistant_message",
        ),
        """SELECT 'orders' AS name, count(*) AS row_count, 6 AS column_count, 0 AS missing_cells, 0 AS duplicate_rows, 6 AS columns, 3 AS numeric_columns, 'histogram,bar,line,heatmap' AS charts,
        CAST(max(o_totalprice) AS VARCHAR) AS last_price,
        (SELECT text FROM conversations WHERE role = 'assistant' AND conv_id = (SELECT max(conv_id) FROM conversations) ORDER BY turn DESC LIMIT 1) AS assistant_message FROM orders""",
    ),
    "conversation_history": (
        lambda spark, folder: conversation_history(table(spark, folder, "conversations")),
        "SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')",
    ),
    "latest_assistant_message": (
        lambda spark, folder: latest_assistant_message(table(spark, folder, "conversations")),
        "SELECT n.conv_id, m.turn, m.text FROM (SELECT max(conv_id) AS conv_id FROM conversations) n LEFT JOIN "
        "(SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') m ON m.conv_id = n.conv_id "
        "ORDER BY m.turn DESC NULLS LAST LIMIT 1",
    ),
}
