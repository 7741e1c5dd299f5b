"""Read-only SQL over one table, known to the text as ``dataset``.

The text must pass a word check and a check of the plan Spark's own parser makes of it. The word list alone
would let through SELECTs that run shell scripts, call Java methods or read files.
"""

from __future__ import annotations

import re
import threading
from typing import Any

from pyspark import SparkContext
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from columnscope.errors import ValidationError
from columnscope.operators.query import capped_summary

VIEW = "dataset"
MAX_ROWS = 1000
MAX_LENGTH = 8000

# Words that may not appear anywhere in the text.
FORBIDDEN_WORDS = frozenset(
    "insert update delete drop alter truncate create attach detach copy export import pragma install load "
    "call set execute grant revoke replace vacuum checkpoint merge".split()
)
# Functions that reach outside the query, and generators that only use their arguments.
FORBIDDEN_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect"})
ALLOWED_GENERATORS = frozenset({
    "range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack",
    "json_tuple",
})
FORBIDDEN_NODES = frozenset({
    "ScriptTransformation", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier",
    "UnresolvedTable", "UnresolvedTableOrView", "RelationTimeTravel",
})
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_view_lock = threading.RLock()


def check_words(sql: str) -> str:
    """The statement without its closing semicolon; typed error if it is not a plain SELECT."""
    body = (sql or "").strip()
    if not body:
        raise ValidationError("There is no statement to run.")
    if len(body) > MAX_LENGTH:
        raise ValidationError(f"A statement may have {MAX_LENGTH} characters at most.")
    body = body.removesuffix(";")
    if ";" in body:
        raise ValidationError("One statement at a time, please: a semicolon may only end it.")
    first = _WORD.match(body)
    if first is None or first.group().lower() not in ("select", "with"):
        raise ValidationError("Statements must begin with SELECT or WITH.")
    blocked = sorted({w.lower() for w in _WORD.findall(body)} & FORBIDDEN_WORDS)
    if blocked:
        raise ValidationError(f"These words may not occur in a statement: {blocked}")
    return body


def _parsed(spark: SparkSession, sql: str) -> Any:
    """The unresolved plan from the session's parser (the one private handle used here)."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node: Any) -> str:
    return node.getClass().getSimpleName()


def _holds_plan(expression: Any) -> bool:
    """Subqueries of any kind; their plan is not among the expression's children."""
    jvm = SparkContext._active_spark_context._jvm
    base = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    return base.isInstance(expression)


def _check_function(parts: list[str]) -> None:
    name = parts[-1].lower()
    if name in FORBIDDEN_FUNCTIONS:
        raise ValidationError(f"Function {name!r} is not allowed.")


def _check_expression(node: Any, visible: frozenset[str]) -> None:
    kind = _kind(node)
    if kind in FORBIDDEN_NODES:
        raise ValidationError(f"{kind} is not allowed in a query.")
    if kind == "UnresolvedFunction":
        _check_function([str(p) for p in _items(node.nameParts())])
    if kind == "UnresolvedGenerator":
        _check_function([str(node.name().funcName())])
    for child in _items(node.children()):
        _check_expression(child, visible)
    if _holds_plan(node):
        _check_plan(node.plan(), visible)


def _check_plan(node: Any, visible: frozenset[str]) -> None:
    """Only ``dataset`` and the common table expressions in scope may be read."""
    kind = _kind(node)
    if kind in FORBIDDEN_NODES or kind.startswith("Create") or kind.startswith("Insert"):
        raise ValidationError(f"{kind} is not allowed in a query.")
    if kind == "UnresolvedRelation":
        parts = [str(p).lower() for p in _items(node.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in visible:
            raise ValidationError(f"Unknown table {'.'.join(parts)!r}; only {VIEW!r} can be read.")
    if kind == "UnresolvedTableValuedFunction":
        name = [str(p) for p in _items(node.name())][-1].lower()
        if name not in ALLOWED_GENERATORS:
            raise ValidationError(f"Table function {name!r} is not allowed.")
    if kind == "UnresolvedWith":
        for pair in _items(node.cteRelations()):
            name = str(pair._1()).lower()
            _check_plan(pair._2(), visible | {name} if node.allowRecursion() else visible)
            visible = visible | {name}
        _check_plan(node.child(), visible)
        return
    for expression in _items(node.expressions()):
        _check_expression(expression, visible)
    for child in _items(node.children()):
        _check_plan(child, visible)


def _query(df: DataFrame, sql: str) -> DataFrame:
    """The uncapped, checked query; its plan is bound to ``df`` before the view name is released."""
    spark = df.sparkSession
    body = check_words(sql)
    try:
        _check_plan(_parsed(spark, body), frozenset({VIEW}))
        with _view_lock:
            earlier = spark.table(VIEW) if spark.catalog._jcatalog.tableExists(VIEW) else None
            # A view of df itself would share its plan, and dropping the view would end the caller's caching.
            df.select("*").createOrReplaceTempView(VIEW)
            try:
                return spark.sql(body)
            finally:
                spark.catalog.dropTempView(VIEW)
                if earlier is not None:
                    earlier.select("*").createOrReplaceTempView(VIEW)
    except (ParseException, AnalysisException) as e:
        raise ValidationError(f"SQL error: {e}") from e
    except Exception as e:
        if type(e).__name__ == "Py4JJavaError":
            raise ValidationError(f"SQL error: {e.java_exception.getMessage()}") from e
        raise


def run_sql(df: DataFrame, sql: str) -> DataFrame:
    """Result of the query, at most 1,000 rows."""
    return _query(df, sql).limit(MAX_ROWS)


def sql_summary(df: DataFrame, sql: str) -> DataFrame:
    """One row: returned rows, total rows, truncated flag."""
    return capped_summary(_query(df, sql), MAX_ROWS)
