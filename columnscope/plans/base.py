"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; sums differ in the last bits with the order of addition."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def dated(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as ISO day text, independent of session time zones."""
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return df


# The given tables hold no missing values; these views make some.
CUSTOMER_WITH_GAPS = """
    SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS segment,
           CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance, c_nationkey
    FROM customer"""


def customer_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_name", "nullif(c_mktsegment, 'BUILDING') as segment",
        "case when c_nationkey % 5 = 0 then null else c_acctbal end as balance", "c_nationkey",
    )
