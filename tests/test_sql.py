from __future__ import annotations

import pandas as pd
import pytest

from columnscope.errors import ValidationError
from columnscope.operators.sql import run_sql, sql_summary


def test_queries(meters):
    assert run_sql(meters, "SELECT station FROM dataset WHERE checks > 3;").count() == 3
    assert run_sql(meters, "WITH w AS (SELECT * FROM dataset) SELECT count(*) c FROM w").first()["c"] == 9
    assert run_sql(meters, "SELECT * FROM dataset d WHERE EXISTS (SELECT 1 FROM dataset e WHERE e.checks > d.checks)").count() == 8


def test_cap(spark):
    df = spark.createDataFrame(pd.DataFrame({"n": range(2000)}))
    assert run_sql(df, "SELECT * FROM dataset").count() == 1000
    assert tuple(sql_summary(df, "SELECT * FROM dataset").first()) == (1000, 2000, True)


@pytest.mark.parametrize("sql", [
    "DROP TABLE dataset", "DELETE FROM dataset", "UPDATE dataset SET checks = 9", "INSERT INTO dataset SELECT * FROM dataset",
    "ALTER TABLE dataset ADD COLUMN x INT", "TRUNCATE dataset", "CREATE TABLE other AS SELECT 1", "ATTACH 'other.db' AS other",
    "PRAGMA table_info(dataset)", "SELECT * FROM dataset; DROP TABLE dataset", "", "   ", "EXPLAIN SELECT * FROM dataset",
    "SELECT FROM WHERE", "SELECT not_a_column FROM dataset", "SELECT delete FROM dataset",
    "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT java_method('java.lang.System', 'currentTimeMillis')",
    "SELECT TRANSFORM(station) USING 'cat' FROM dataset", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM hidden",
    "SELECT (SELECT max(id) FROM hidden) FROM dataset", "SELECT * FROM dataset WHERE checks IN (SELECT id FROM hidden)",
    "SELECT * FROM hidden WHERE 1 IN (WITH hidden AS (SELECT 1) SELECT * FROM hidden)",
    "SELECT * FROM IDENTIFIER('hidden')", "SELECT * FROM dataset, LATERAL (SELECT * FROM hidden)",
    "SELECT 1" + " " * 10 + "-- " + "x" * 8000,
])
def test_rejected(spark, meters, sql):
    spark.range(3).createOrReplaceTempView("hidden")
    with pytest.raises(ValidationError):
        run_sql(meters, sql).collect()


def test_an_earlier_view_is_restored(spark, meters):
    spark.range(7).createOrReplaceTempView("dataset")
    assert run_sql(meters, "SELECT * FROM dataset").count() == 9
    assert spark.table("dataset").count() == 7
    spark.catalog.dropTempView("dataset")
