"""Correlation and outliers."""

from __future__ import annotations

from columnscope.operators.correlation import correlation, strong_pairs
from columnscope.operators.outliers import flag_outliers, outlier_rows, outlier_summary
from columnscope.plans.base import CUSTOMER_WITH_GAPS, customer_with_gaps, rounded, table

GAPS = f"({CUSTOMER_WITH_GAPS})"
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix(columns, cell) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(({cell(a, b)}), 4) AS correlation"
        for a in columns for b in columns
    )


def _rank(c: str) -> str:
    return (
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    )


def _spearman(source, a, b) -> str:
    return (
        f"SELECT corr(ra, rb) FROM (SELECT {_rank(a)} AS ra, {_rank(b)} AS rb FROM {source} t "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    )


def _kendall(source, a, b) -> str:
    """All pairs of rows, on small tables only: the definition itself."""
    return (
        f"SELECT sum(s) / (sqrt(CAST(sum(abs(sx)) AS DOUBLE)) * sqrt(CAST(sum(abs(sy)) AS DOUBLE))) FROM ("
        f"SELECT sign(p.{a} - q.{a}) AS sx, sign(p.{b} - q.{b}) AS sy, sign(p.{a} - q.{a}) * sign(p.{b} - q.{b}) AS s "
        f"FROM {source} p, {source} q WHERE p.{a} IS NOT NULL AND p.{b} IS NOT NULL AND q.{a} IS NOT NULL AND "
        f"q.{b} IS NOT NULL)"
    )


def _iqr(source: str, column: str) -> str:
    return (
        f"SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT quantile_cont({column}, 0.25) "
        f"AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source} t) WHERE q3 > q1"
    )


def _skewed(spark, folder):
    """Events with a heavy-tailed column."""
    return table(spark, folder, "events").selectExpr("event_id", "value", "value * value * value as cubed", "user_id")


SKEWED = "(SELECT event_id, value, value * value * value AS cubed, user_id FROM events)"


def _summary_sql(method: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        if method == "iqr":
            test = f"SELECT count(*) FROM {SKEWED} t, ({_iqr(SKEWED, c)}) f WHERE {c} < low OR {c} > high"
        else:
            test = (
                f"SELECT count(*) FROM {SKEWED} t, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {SKEWED} t) f "
                f"WHERE abs({c} - m) / s > 3"
            )
        parts.append(
            f"SELECT '{c}' AS \"column\", '{method}' AS method, ({test}) AS outlier_count, "
            f"round(100.0 * ({test}) / (SELECT count({c}) FROM {SKEWED} t), 4) AS outlier_percentage"
        )
    return " UNION ALL ".join(parts)


ENTRIES = {
    "corr_pearson": (
        lambda spark, folder: correlation(table(spark, folder, "lineitem"), LINE),
        _matrix(LINE, lambda a, b: f"SELECT corr({a}, {b}) FROM lineitem"),
    ),
    "corr_pearson_gaps": (
        lambda spark, folder: correlation(
            customer_with_gaps(spark, folder).selectExpr("c_custkey", "balance", "c_nationkey", "1 as constant")
        ),
        _matrix(
            ["c_custkey", "balance", "c_nationkey", "constant"],
            lambda a, b: "CAST(NULL AS DOUBLE)" if "constant" in (a, b) else f"SELECT corr({a}, {b}) FROM {GAPS} t",
        ),
    ),
    "corr_spearman": (
        lambda spark, folder: correlation(table(spark, folder, "lineitem"), LINE, "spearman"),
        _matrix(LINE, lambda a, b: _spearman("lineitem", a, b)),
    ),
    "corr_spearman_gaps": (
        lambda spark, folder: correlation(
            customer_with_gaps(spark, folder), ["c_custkey", "balance", "c_nationkey"], "spearman"
        ),
        _matrix(["c_custkey", "balance", "c_nationkey"], lambda a, b: _spearman(GAPS, a, b)),
    ),
    "corr_kendall": (
        lambda spark, folder: correlation(table(spark, folder, "part"), ["p_size", "p_retailprice"], "kendall"),
        _matrix(["p_size", "p_retailprice"], lambda a, b: _kendall("part", a, b)),
    ),
    "corr_kendall_gaps": (
        lambda spark, folder: correlation(customer_with_gaps(spark, folder), ["balance", "c_nationkey"], "kendall"),
        _matrix(["balance", "c_nationkey"], lambda a, b: _kendall(GAPS, a, b)),
    ),
    "strong_pairs": (
        lambda spark, folder: strong_pairs(table(spark, folder, "lineitem").selectExpr(
            "l_quantity", "l_extendedprice", "l_quantity * 2 + l_tax as doubled", "-l_extendedprice + l_quantity as negated"
        )),
        "WITH t AS (SELECT l_quantity, l_extendedprice, l_quantity * 2 + l_tax AS doubled, -l_extendedprice + l_quantity "
        "AS negated FROM lineitem), p AS (" + " UNION ALL ".join(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, (SELECT corr({a}, {b}) FROM t) AS r"
            for i, a in enumerate(["l_quantity", "l_extendedprice", "doubled", "negated"])
            for b in ["l_quantity", "l_extendedprice", "doubled", "negated"][i + 1:]
        ) + ") SELECT column_a, column_b, round(r, 4) AS correlation FROM p WHERE abs(r) >= 0.7",
    ),
    "outliers_iqr": (
        lambda spark, folder: outlier_summary(_skewed(spark, folder), ["value", "cubed", "user_id"], "iqr"),
        _summary_sql("iqr", ["value", "cubed", "user_id"]),
    ),
    "outliers_zscore": (
        lambda spark, folder: outlier_summary(_skewed(spark, folder), ["value", "cubed", "user_id"], "zscore"),
        _summary_sql("zscore", ["value", "cubed", "user_id"]),
    ),
    "outlier_rows": (
        lambda spark, folder: rounded(outlier_rows(_skewed(spark, folder), ["value", "cubed"], "iqr"), 3),
        " UNION ALL ".join(
            f"SELECT * FROM (SELECT '{c}' AS outlier_column, round(greatest({c} - high, low - {c}), 3) AS deviation, "
            f"row_number() OVER (ORDER BY greatest({c} - high, low - {c}) DESC, event_id) AS rank, event_id, "
            f"round(value, 3) AS value, round(cubed, 3) AS cubed, user_id FROM {SKEWED} t, ({_iqr(SKEWED, c)}) f "
            f"WHERE {c} < low OR {c} > high) WHERE rank <= 20"
            for c in ("value", "cubed")
        ),
    ),
    "flag_outliers": (
        lambda spark, folder: rounded(flag_outliers(_skewed(spark, folder), "cubed").select(
            "event_id", "deviation", "is_outlier"
        ), 3),
        f"SELECT event_id, round(greatest(cubed - high, low - cubed, 0), 3) AS deviation, "
        f"cubed < low OR cubed > high AS is_outlier FROM {SKEWED} t, ({_iqr(SKEWED, 'cubed')}) f",
    ),
}
