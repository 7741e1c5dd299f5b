from __future__ import annotations

import pandas as pd
import pytest

from columnscope.errors import ValidationError
from columnscope.operators.query import (
    apply_filters, preview, preview_info, query_summary, run_query, search_rows, trim_arrays,
)


def rows(df):
    return [tuple(r) for r in df.collect()]


def where(df, column, operator, value=None):
    return apply_filters(df, [dict(column=column, operator=operator, value=value)])


@pytest.mark.parametrize("column, operator, value, count", [
    ("station", "eq", "Nord", 3), ("station", "ne", "Nord", 6), ("load", "gt", "30", 4), ("load", "gte", 22, 5),
    ("load", "lt", 12.5, 2), ("load", "lte", "12.5", 3), ("model", "in", ["K2", "K9"], 6), ("model", "in", [7, 9], 0),
    ("model", "not_in", ["K2"], 5), ("model", "contains", "k7", 3), ("station", "is_null", None, 0),
    ("station", "not_null", None, 9), ("checks", "gt", 2.5, 5), ("checks", "eq", 2.5, 0), ("checks", "ne", 2.5, 9),
    ("checks", "lt", 1e30, 9), ("checks", "gt", -1e30, 9), ("read_on", "gte", "2031-03-09", 4),
    ("read_on", "eq", "March 5, 2031", 1), ("station", "eq", 5, 0),
])
def test_filters(meters, column, operator, value, count):
    assert where(meters, column, operator, value).count() == count


def test_missing_values_in_filters(spark):
    df = spark.createDataFrame(pd.DataFrame({"n": [1.0, None, 3.0], "s": ["x", None, "y"]}))
    nan = spark.sql("select * from values (1d), (double('NaN')), (cast(null as double)) as t(n)")
    assert where(df, "n", "is_null").count() == 1
    assert where(df, "n", "ne", 1).count() == 2
    assert where(df, "n", "not_in", [1.0]).count() == 2
    assert where(df, "n", "in", [1.0, None]).count() == 2
    assert where(df, "s", "contains", "none").count() == 0
    assert where(nan, "n", "is_null").count() == 2
    assert where(nan, "n", "not_null").count() == 1
    assert where(nan, "n", "gt", 0).count() == 1
    assert where(nan, "n", "ne", 1).count() == 2


@pytest.mark.parametrize("spec", [
    dict(column="absent", operator="eq", value=1), dict(column="model", operator="like", value="K"),
    dict(column="model", operator="in", value="K2"), dict(column="model", operator="not_in", value="K2"),
    dict(column="load", operator="gt", value="heavy"), dict(column="read_on", operator="gt", value="one day"),
])
def test_bad_filters(meters, spec):
    with pytest.raises(ValidationError):
        apply_filters(meters, [spec])


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as double) as x", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = apply_filters(df, [
        dict(column="id", operator="gte", value=5.5), dict(column="x", operator="lt", value="50"),
    ]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,6)" in plan and "LessThan(x,50.0)" in plan


def test_group_and_sort(meters):
    got = rows(run_query(
        meters, group_by=["station"], metrics=[dict(aggregation="sum", column="load", alias="power")], sort=dict(by="power")
    ))
    assert got == [("Ost", 103.0), ("Hafen", 64.0), ("Nord", 61.5), ("Süd", 14.5)]


@pytest.mark.parametrize("route", ["window", "counted"])
def test_every_aggregation(meters, request, route):
    if route == "counted":
        request.getfixturevalue("counted")
    metrics = [dict(aggregation=a, column="load") for a in ("count", "std", "max", "min", "median", "mean", "sum")]
    got = {r["station"]: r.asDict() for r in run_query(meters, group_by=["station"], metrics=metrics).collect()}
    assert list(got) == ["Hafen", "Nord", "Ost", "Süd"]
    assert got["Nord"] == dict(
        station="Nord", count_load=3, std_load=pytest.approx(84 ** 0.5), max_load=30.5, min_load=12.5, median_load=18.5, mean_load=20.5, sum_load=61.5
    )
    assert got["Süd"]["std_load"] == 0 and got["Hafen"]["std_load"] is None
    whole = run_query(meters, metrics=[dict(aggregation="mean", column="load"), dict(aggregation="median", column="checks")])
    assert rows(whole) == [(27.0, 3.0)]


def test_missing_keys_and_sums(spark, counted):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a", None, "a", None, "b"], "v": [1.0, None, 3.0, None, None]}))
    got = rows(run_query(df, group_by=["k"], metrics=[
        dict(aggregation="sum", column="v"), dict(aggregation="median", column="v"), dict(aggregation="count"),
    ]))
    assert got == [("a", 4.0, 2.0, 2), ("b", 0.0, None, 1), (None, 0.0, None, 2)]


def test_nan_joins_the_missing_group(spark):
    df = spark.sql("select * from values (double('NaN')), (cast(null as double)), (1d) as t(k)")
    assert rows(run_query(df, group_by=["k"])) == [(1.0, 1), (None, 2)]


def test_default_metric_and_aliases(meters):
    assert rows(run_query(meters, group_by=["model"])) == [("K2", 4), ("K7", 3), ("K9", 2)]
    with pytest.raises(ValidationError):
        run_query(meters, group_by=["model"], metrics=[dict(aggregation="count"), dict(aggregation="count")])


@pytest.mark.parametrize("request_", [
    dict(group_by=["absent"]), dict(metrics=[dict(aggregation="max", column="absent")]),
    dict(metrics=[dict(aggregation="mode", column="checks")]), dict(metrics=[dict(aggregation="min")]),
    dict(metrics=[dict(aggregation="sum", column="model")]), dict(group_by=["model"], sort=dict(by="absent")),
])
def test_bad_requests(meters, request_):
    with pytest.raises(ValidationError):
        run_query(meters, **request_)


def test_caps(spark):
    df = spark.createDataFrame(pd.DataFrame({"n": range(1500)}))
    assert run_query(df).count() == 1000
    assert run_query(df, limit=1200).count() == 1200
    assert rows(query_summary(df)) == [(1000, 1500, True)]
    assert rows(query_summary(df, limit=5000)) == [(1500, 1500, False)]


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame(pd.DataFrame({"n": [2.0, None, 1.0]}))
    assert [r[0] for r in rows(run_query(df, sort=dict(by="n", direction="asc")))] == [1.0, 2.0, None]
    assert [r[0] for r in rows(run_query(df, sort=dict(by="n")))] == [2.0, 1.0, None]


def test_preview(boats):
    assert rows(preview_info(boats, page_size=5)) == [(1, 5, 14, 3)]
    assert search_rows(boats, "LABOE").count() == 3 and search_rows(boats, "9.3").count() == 3
    assert preview(boats, page_size=1, sort="length", sort_dir="desc").first()["hull"] == 508
    assert [r["hull"] for r in preview(boats, page=3, page_size=5).collect()] == [511, 512, 513, 514]
    assert preview(boats, sort="absent").count() == 14


def test_results_do_not_depend_on_partitioning(meters):
    request = dict(group_by=["station"], metrics=[dict(aggregation="median", column="load"), dict(aggregation="count")])
    assert rows(run_query(meters.repartition(1), **request)) == rows(run_query(meters.repartition(6), **request))


def test_trim_arrays(spark):
    df = spark.createDataFrame([(list(range(25)),), ([1],)], "a array<int>")
    assert [(len(r["a"]), r["a_cut"]) for r in trim_arrays(df).collect()] == [(20, 5), (1, 0)]
