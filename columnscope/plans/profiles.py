"""Profiling, column by column."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from columnscope.functions.columns import as_number
from columnscope.functions.sizing import shared_folder
from columnscope.operators.profile import column_stubs, profile
from columnscope.operators.sketches import approximate_profile
from columnscope.plans.base import CUSTOMER_WITH_GAPS, customer_with_gaps, rounded, table
from columnscope.sources.increments import profile_of_files

GAPS = f"({CUSTOMER_WITH_GAPS})"
LINEITEM_NUMBERS = {
    0: "l_orderkey", 1: "l_partkey", 2: "l_suppkey", 3: "l_linenumber", 4: "l_quantity", 5: "l_extendedprice",
    6: "l_discount", 7: "l_tax",
}
GAP_COLUMNS = ["c_custkey", "c_name", "segment", "balance", "c_nationkey"]


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _numeric_sql(source: str, columns: dict[int, str]) -> str:
    return _union(
        f"SELECT {pos} AS position, '{c}' AS name, s.count AS count, s.mean, s.median, s.std, s.min, s.max, "
        "s.q1, s.q3, s.skewness, o.n AS outlier_count, round(100.0 * o.n / s.count, 4) AS outlier_percentage FROM ("
        f"SELECT count({c}) AS count, round(avg({c}), 4) AS mean, round(CAST(median({c}) AS DOUBLE), 4) AS median, "
        f"round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
        f"round(CAST(max({c}) AS DOUBLE), 4) AS max, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q1, "
        f"round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q3, round(coalesce(skewness({c}), 0), 4) AS skewness "
        f"FROM {source} t) s, (SELECT count(*) AS n FROM {source} t, (SELECT "
        f"CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS a, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS b FROM {source} t) q "
        f"WHERE q.b > q.a AND ({c} < q.a - 1.5 * (q.b - q.a) OR {c} > q.b + 1.5 * (q.b - q.a))) o"
        for pos, c in columns.items()
    )


def _key_or_measure(column: str) -> str:
    return f"CASE WHEN count(DISTINCT {column}) = count(*) AND count(*) > 1 THEN 'identifier' ELSE 'measure' END"


def _numeric(spark, folder, name):
    return rounded(profile(table(spark, folder, name)).numeric_frame(), 4)


def _top_sql(source: str, pos: int, column: str) -> str:
    return (
        f"SELECT {pos} AS position, '{column}' AS name, (SELECT count(DISTINCT {column}) FROM {source} t) AS "
        f"distinct_count, {column} AS value, n AS count, round(100.0 * n / (SELECT count({column}) FROM {source} t), 4) AS "
        f"percentage FROM (SELECT {column}, count(*) AS n FROM {source} t WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY n DESC, {column} LIMIT 10)"
    )


def _facts(spark, folder):
    return rounded(profile(customer_with_gaps(spark, folder)).columns_frame().select(
        "position", "name", "inferred_type", "logical_type", "null_count", "null_percentage", "unique_count",
        "cardinality_ratio",
    ))


def _facts_sql() -> str:
    types = {
        "c_custkey": ("integer", "identifier"), "c_name": ("text", "identifier"), "segment": ("categorical", "category"),
        "balance": ("float", "measure"), "c_nationkey": ("integer", "measure"),
    }
    return _union(
        f"SELECT {i} AS position, '{c}' AS name, '{types[c][0]}' AS inferred_type, '{types[c][1]}' AS logical_type, "
        f"count(*) - count({c}) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_percentage, "
        f"count(DISTINCT {c}) AS unique_count, round(1.0 * count(DISTINCT {c}) / count({c}), 4) AS cardinality_ratio "
        f"FROM {GAPS} t"
        for i, c in enumerate(GAP_COLUMNS)
    )


def _repeated(spark, folder):
    """Few columns of lineitem: many duplicate rows, some missing values."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_linenumber", "nullif(l_returnflag, 'R') as flag", "l_linestatus", "'x' as constant"
    )


REPEATED = "(SELECT l_linenumber, nullif(l_returnflag, 'R') AS flag, l_linestatus, 'x' AS constant FROM lineitem)"


def _summary(spark, folder):
    return rounded(profile(_repeated(spark, folder)).summary_frame().select(
        "row_count", "column_count", "missing_cells", "missing_percentage", "duplicate_rows", "duplicate_percentage",
        "quality.*",
    ))


SUMMARY_SQL = f"""
WITH f AS (
  SELECT count(*) AS n, count(*) - count(flag) AS missing FROM {REPEATED} t
), d AS (
  SELECT count(*) AS k FROM (SELECT DISTINCT * FROM {REPEATED} t)
), s AS (
  SELECT n, missing, n - k AS dup, 10 * (1 - missing / (4.0 * n)) AS completeness, 7.5 AS missing_values,
         10 * (1 - (n - k) / (1.0 * n)) AS duplicates
  FROM f, d
)
SELECT n AS row_count, 4 AS column_count, missing AS missing_cells, round(100.0 * missing / (4 * n), 4) AS
  missing_percentage, dup AS duplicate_rows, round(100.0 * dup / n, 4) AS duplicate_percentage,
  CAST(round((completeness + missing_values + duplicates + 20) * 2) AS INTEGER) AS overall,
  CAST(round(completeness, 1) AS DOUBLE) AS completeness, CAST(7.5 AS DOUBLE) AS missing_values,
  CAST(round(duplicates, 1) AS DOUBLE) AS duplicates, CAST(10 AS DOUBLE) AS data_types, CAST(10 AS DOUBLE) AS outliers
FROM s"""

ISSUES_SQL = f"""
WITH f AS (SELECT count(*) AS n, count(*) - count(flag) AS missing FROM {REPEATED} t),
     d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM {REPEATED} t))
SELECT 'missing_values' AS type, 'flag' AS "column", 'medium' AS severity FROM f WHERE 100.0 * missing / n > 5
UNION ALL SELECT 'constant_column', 'constant', 'low'
UNION ALL SELECT 'constant_column', 'flag', 'low' WHERE (SELECT count(DISTINCT flag) FROM {REPEATED} t) <= 1
UNION ALL SELECT 'duplicate_rows', NULL, CASE WHEN (n - k) / (1.0 * n) < 0.1 THEN 'medium' ELSE 'high' END FROM f, d
WHERE n > k"""

STUBS_SQL = _union(
    f"SELECT '{c}' AS name, {i} AS position, {kind} AS inferred_type, count(*) - count({c}) AS null_count, "
    f"count(DISTINCT {c}) AS unique_count FROM {GAPS} t"
    for i, (c, kind) in enumerate({
        "c_custkey": "'integer'", "balance": "'float'",
        "segment": "CASE WHEN count(DISTINCT segment) < 0.5 * count(segment) THEN 'categorical' ELSE 'text' END",
        "c_name": "CASE WHEN count(DISTINCT c_name) < 0.5 * count(c_name) THEN 'categorical' ELSE 'text' END",
    }.items())
)

ENTRIES = {
    "profile_columns": (_facts, _facts_sql()),
    "profile_numeric": (partial(_numeric, name="lineitem"), _numeric_sql("lineitem", LINEITEM_NUMBERS)),
    "profile_numeric_gaps": (
        lambda spark, folder: rounded(profile(customer_with_gaps(spark, folder)).numeric_frame()),
        _numeric_sql(GAPS, {0: "c_custkey", 3: "balance", 4: "c_nationkey"}),
    ),
    "profile_top_categories": (
        lambda spark, folder: rounded(profile(
            table(spark, folder, "part").select("p_name", "p_brand", "p_type")
        ).categorical_frame()),
        _union(f"SELECT * FROM ({_top_sql('part', i, c)})" for i, c in enumerate(["p_name", "p_brand", "p_type"])),
    ),
    "profile_datetime": (
        lambda spark, folder: profile(table(spark, folder, "orders").selectExpr(
            "o_orderdate", "if(o_orderkey % 20 = 0, 'unknown', date_format(o_orderdate, 'M/d/yyyy')) as as_text"
        )).datetime_frame(),
        _union(
            f"SELECT {i} AS position, '{c}' AS name, strftime(min(d), '%Y-%m-%dT%H:%M:%S') AS min_date, "
            "strftime(max(d), '%Y-%m-%dT%H:%M:%S') AS max_date, date_diff('day', min(d), max(d)) AS range_days, "
            "count(*) - count(d) AS invalid_count, round(100.0 * (count(*) - count(d)) / count(*), 4) AS "
            f"invalid_percentage FROM (SELECT {e} AS d FROM orders)"
            for i, (c, e) in enumerate({
                "o_orderdate": "o_orderdate", "as_text": "CASE WHEN o_orderkey % 20 <> 0 THEN o_orderdate END",
            }.items())
        ),
    ),
    "profile_boolean": (
        lambda spark, folder: profile(table(spark, folder, "labels").selectExpr(
            "quality = 1 as good", "toxic = 1 as toxic"
        )).columns_frame().select("name", "logical_type", "boolean.*"),
        _union(
            f"SELECT '{n}' AS name, 'flag' AS logical_type, count(*) FILTER (WHERE {c} = 1) AS true_count, "
            f"count(*) FILTER (WHERE {c} <> 1) AS false_count FROM labels"
            for n, c in (("good", "quality"), ("toxic", "toxic"))
        ),
    ),
    "profile_duplicates_quality": (_summary, SUMMARY_SQL),
    "profile_issues": (
        lambda spark, folder: profile(_repeated(spark, folder)).issues_frame().select("type", "column", "severity"),
        ISSUES_SQL,
    ),
    "profile_texts": (
        lambda spark, folder: rounded(profile(table(spark, folder, "documents")).columns_frame().select(
            "name", "null_count", "unique_count", "cardinality_ratio"
        )),
        _union(
            f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, "
            f"round(1.0 * count(DISTINCT {c}) / count({c}), 4) AS cardinality_ratio FROM documents"
            for c in ("doc_id", "text", "lang", "source", "n_chars")
        ),
    ),
    "schema_listing": (
        lambda spark, folder: profile(table(spark, folder, "supplier")).schema_listing(),
        _union(
            f"SELECT count(*) AS row_count, 4 AS column_count, {i} AS position, '{c}' AS name, '{t}' AS inferred_type, "
            f"{lt} AS logical_type, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM supplier"
            for i, (c, t, lt) in enumerate([
                ("s_suppkey", "integer", _key_or_measure("s_suppkey")), ("s_name", "text", "'identifier'"),
                ("s_nationkey", "integer", _key_or_measure("s_nationkey")), ("s_acctbal", "float", "'measure'"),
            ])
        ),
    ),
    "column_stubs": (
        lambda spark, folder: column_stubs(customer_with_gaps(spark, folder).select("c_custkey", "balance", "segment", "c_name")),
        STUBS_SQL,
    ),
}


SKETCHED = {"l_partkey": "l_partkey", "l_quantity": "l_quantity", "l_extendedprice": "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END", "flag": "nullif(l_returnflag, 'R')"}


def _approximate(spark, folder):
    """Statistics by sketches: what is exact, and whether the estimates keep within their stated errors (three of them for distinct values)."""
    df = table(spark, folder, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in SKETCHED.items()])
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in SKETCHED]).select(F.stack(F.lit(len(SKETCHED)), *[x for c in SKETCHED for x in (F.lit(c), F.col(c))]).alias("name", "exact"))
    found = approximate_profile(df).join(exact, "name")
    middle = found.select(F.max(F.when(F.col("name") == "l_extendedprice", F.col("median"))).alias("middle"))
    below = df.join(F.broadcast(middle)).agg(F.try_divide(F.count_if(F.col("l_extendedprice") <= F.col("middle")), F.count("l_extendedprice")).alias("share"))
    return rounded(found.join(F.broadcast(below)).select(
        "name", "rows", "missing", "count", "mean", "std", "min", "max",
        (F.abs(F.col("distinct") - F.col("exact")) <= 3 * F.col("distinct_error") * F.col("exact")).alias("distinct_within"),
        F.when(F.col("name") == "l_extendedprice", F.abs(F.col("share") - 0.5) <= F.col("rank_error") + 0.001).alias("median_within"),
    ))


def _increments(spark, folder):
    """Orders in three steps: the second profile reads one new file, the third none."""
    place = f"{shared_folder(spark)}/increments-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    reads = []
    for part in (0, 1, None):
        if part is not None:
            orders.where(f"o_orderkey % 2 = {part}").coalesce(1).write.mode("append").parquet(f"{place}/table")
        rows, read = profile_of_files(spark, f"{place}/table", f"{place}/states")
        reads.append(read)
    return rounded(rows.select("name", "rows", "missing", "mean", "std", "min", "max", F.lit("-".join(map(str, reads))).alias("files_read")))


def _all_issues(spark, folder):
    """A table with every kind of issue, from customers and their numbers."""
    return profile(table(spark, folder, "customer").selectExpr(
        "c_custkey as number", "if(c_custkey % 12 = 0, 1e6, c_nationkey) as spread", "if(c_custkey % 40 = 0, 'later', cast(date_add(date'2030-01-01', cast(c_custkey % 500 as int)) as string)) as day",
        "concat('k', c_custkey % 60) as kind", "'same' as fixed", "if(c_custkey % 3 = 0, c_mktsegment, null) as sparse",
    ).unionAll(spark.createDataFrame([], "number long, spread double, day string, kind string, fixed string, sparse string")))


def _numbers_in_text(spark, folder):
    """Text that holds numbers is summed over months as numbers; what is none counts as missing."""
    rows = table(spark, folder, "orders").selectExpr("o_orderdate", "if(o_orderkey % 7 = 0, 'n/a', cast(round(o_totalprice) as string)) as price")
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(as_number(rows, "price")).alias("total"), F.count(as_number(rows, "price")).alias("n"))


ENTRIES |= {
    "approx_profile": (
        _approximate,
        _union(
            f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count(v) AS missing, {'count(v)' if c != 'flag' else '0'} AS count, "
            + (f"round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max" if c != "flag" else
               "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
            + f", TRUE AS distinct_within, {'TRUE' if c == 'l_extendedprice' else 'CAST(NULL AS BOOLEAN)'} AS median_within FROM (SELECT {e} AS v FROM lineitem)"
            for c, e in SKETCHED.items()
        ),
    ),
    "profile_increments": (
        _increments,
        _union(
            f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, '1-1-0' AS files_read FROM orders"
            for c in ("o_orderkey", "o_custkey", "o_totalprice")
        ),
    ),
    "profile_all_issues": (
        lambda spark, folder: _all_issues(spark, folder).issues_frame().select("type", "column", "severity"),
        """SELECT * FROM (VALUES ('likely_identifier', 'number', 'info'), ('extreme_outliers', 'spread', 'medium'), ('invalid_dates', 'day', 'low'),
        ('high_cardinality_categorical', 'kind', 'low'), ('constant_column', 'fixed', 'low'), ('missing_values', 'sparse', 'high')) t(type, "column", severity)
        WHERE (SELECT count(*) FROM customer) > 0""",
    ),
    "profile_edges": (
        lambda spark, folder: _all_issues(spark, folder).columns_frame().select("name", "inferred_type", "min_value", "max_value"),
        """SELECT 'number' AS name, 'integer' AS inferred_type, CAST(min(c_custkey) AS VARCHAR) AS min_value, CAST(max(c_custkey) AS VARCHAR) AS max_value FROM customer
        UNION ALL SELECT 'spread', 'float', CAST(min(CAST(c_nationkey AS DOUBLE)) FILTER (c_custkey % 12 <> 0) AS VARCHAR), '1000000.0' FROM customer
        UNION ALL SELECT 'day', 'datetime', strftime(min(d), '%Y-%m-%dT%H:%M:%S'), strftime(max(d), '%Y-%m-%dT%H:%M:%S') FROM (SELECT DATE '2030-01-01' + CAST(c_custkey % 500 AS INT) AS d FROM customer WHERE c_custkey % 40 <> 0)
        UNION ALL SELECT unnest(['kind', 'fixed', 'sparse']), 'categorical', NULL, NULL""",
    ),
    "numbers_in_text": (
        _numbers_in_text,
        """SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(round(o_totalprice)) FILTER (o_orderkey % 7 <> 0) AS total, count(*) FILTER (o_orderkey % 7 <> 0) AS n
        FROM orders GROUP BY 1""",
    ),
}
