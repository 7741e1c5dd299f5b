"""Model training. Fitted numbers depend on the library, so most have no SQL; exact parts do."""

from __future__ import annotations

from pyspark.sql import functions as F

from columnscope.operators.learning import train
from columnscope.operators.learning.prepare import Preparation, feature_table
from columnscope.operators.learning.supervised import class_counts, stratified_split
from columnscope.plans.base import CUSTOMER_WITH_GAPS, customer_with_gaps, table


def _lines(spark, folder):
    """A target that follows from the features up to noise, and a class label derived from it."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_quantity * 10 + l_discount * 100 + if(l_returnflag = 'A', 25, 0) + pmod(l_partkey, 7) as score",
        "if(l_quantity + pmod(l_partkey, 5) > 27, 'large', 'small') as size",
    )


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _train(task, target=None, algorithm=None, features=FEATURES, **more):
    return lambda spark, folder: train(_lines(spark, folder), task, features, target, algorithm, **more)


def _metrics(*args, **kwargs):
    fit = _train(*args, **kwargs)
    return lambda spark, folder: fit(spark, folder).metrics_frame()


def _split_counts(spark, folder):
    parts = stratified_split(table(spark, folder, "orders"), "o_orderpriority", ["o_orderkey", "o_totalprice"])
    named = [p.select("o_orderpriority", F.lit(n).alias("part")) for p, n in zip(parts, ("train", "test"))]
    return named[0].unionByName(named[1]).groupBy("o_orderpriority", "part").agg(F.count(F.lit(1)).alias("n"))


SPLIT_SQL = """
WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
     t AS (SELECT sum(n) AS total, sum(n) - ceil(sum(n) * 0.2 - 1e-9) AS train FROM c),
     e AS (SELECT label, n, train, CAST(n AS DOUBLE) * train / total AS share FROM c, t),
     r AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, label) AS k,
                  train - sum(floor(share)) OVER () AS spare FROM e),
     f AS (SELECT label, n, CAST(floor(share) + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS kept FROM r)
SELECT label AS o_orderpriority, 'train' AS part, kept AS n FROM f UNION ALL SELECT label, 'test', n - kept FROM f"""


def _anomaly_count(spark, folder):
    return train(
        table(spark, folder, "orders"), "anomaly_detection", ["o_totalprice", "o_custkey"], contamination=0.02
    ).sample_rows.drop("anomaly_score")


def _separated(spark, folder):
    """Orders in two groups far apart, of even and odd keys."""
    return table(spark, folder, "orders").selectExpr("o_orderkey % 2 * 1000 + o_custkey % 10 as x", "o_orderkey % 2 * -500 + o_orderkey % 7 as y")


SEPARATED = "(SELECT o_orderkey % 2 * 1000 + o_custkey % 10 AS x, o_orderkey % 2 * -500 + o_orderkey % 7 AS y, o_orderkey % 2 AS g FROM orders)"


def _separated_clusters(spark, folder):
    found = train(_separated(spark, folder), "clustering", ["x", "y"], n_clusters=2).clusters_frame()
    return found.select("size", F.round(F.get("centroid", F.lit(0)), 4).alias("x"), F.round(F.get("centroid", F.lit(1)), 4).alias("y"))


# All pairs, on a small table: suppliers in two groups.
SILHOUETTE_SQL = """
WITH p AS (SELECT s_suppkey AS id, s_suppkey % 2 AS g, s_suppkey % 2 * 60 + s_nationkey AS x FROM supplier),
     z AS (SELECT id, g, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x FROM p),
     d AS (SELECT a.id, a.g, sum(abs(a.x - b.x)) FILTER (a.g = b.g) / (count(*) FILTER (a.g = b.g) - 1) AS inside,
                  avg(abs(a.x - b.x)) FILTER (a.g <> b.g) AS outside FROM z a, z b GROUP BY a.id, a.g)
SELECT 'silhouette_score' AS metric, round(avg((outside - inside) / greatest(outside, inside)), 4) AS value FROM d"""


def _silhouette(spark, folder):
    rows = table(spark, folder, "supplier").selectExpr("s_suppkey % 2 * 60 + s_nationkey as x")
    return train(rows, "clustering", ["x"], n_clusters=2).metrics_frame().select("metric", F.round("value", 4).alias("value"))


def _exact_line(spark, folder):
    """A target without noise is predicted without error."""
    rows = table(spark, folder, "lineitem").selectExpr("l_quantity", "l_discount", "l_returnflag", "3 * l_quantity - 20 * l_discount + if(l_returnflag = 'A', 5, 1) as y")
    return train(rows, "regression", ["l_quantity", "l_discount", "l_returnflag"], "y", "linear_regression").metrics_frame().select("metric", F.round(F.abs("value"), 3).alias("value"))


def _separable(algorithm):
    """A class that a category decides."""
    def run(spark, folder):
        rows = table(spark, folder, "lineitem").selectExpr("l_tax", "l_returnflag", "if(l_returnflag = 'N', 'kept', 'returned') as fate")
        return train(rows, "classification", ["l_tax", "l_returnflag"], "fate", algorithm).metrics_frame().select("metric", "value")

    return run


def _confusion_totals(spark, folder):
    found = _train("classification", "size")(spark, folder).confusion_frame()
    return found.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("n"))


def _prepared(spark, folder):
    """What missing values are filled with."""
    rows = feature_table(customer_with_gaps(spark, folder), ["balance", "segment"])
    prepared = Preparation(["balance"], ["segment"])
    stages, _ = prepared.fit(rows)
    mean = stages[0].surrogateDF.selectExpr("'balance' as feature", "cast(round(n0, 2) as string) as filled_with")
    return mean.unionAll(spark.createDataFrame([("segment", prepared.modes["t0"])], mean.schema))


def _far_out(spark, folder):
    """Planted far values are among the anomalies."""
    rows = table(spark, folder, "orders").selectExpr("o_orderkey", "if(o_orderkey % 500 = 0, 1e9 + o_orderkey, o_totalprice) as price", "o_custkey")
    scored = train(rows, "anomaly_detection", ["price"], contamination=0.05).scored
    return scored.where("is_anomaly and o_orderkey % 500 = 0").select("o_orderkey")


def _test_rows(label, source):
    return SPLIT_SQL.split("SELECT label AS o_orderpriority")[0].replace("SELECT o_orderpriority AS label, count(*) AS n FROM orders", f"SELECT {label} AS label, count(*) AS n FROM {source}") + (
        "SELECT label, n - kept AS n FROM f WHERE n > kept"
    )


ENTRIES = {
    "cluster_separated": (_separated_clusters, f"SELECT count(*) AS size, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM {SEPARATED} GROUP BY g"),
    "cluster_silhouette": (_silhouette, SILHOUETTE_SQL),
    "regression_exact": (_exact_line, "SELECT unnest(['r2', 'mae', 'mse', 'rmse']) AS metric, unnest([1.0, 0.0, 0.0, 0.0]) AS value FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0"),
    **{
        f"classification_separable_{a}": (
            _separable(a),
            "SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) AS metric, CAST(1 AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0",
        )
        for a in ("logistic_regression", "random_forest")
    },
    "confusion_totals": (_confusion_totals, _test_rows("CASE WHEN l_quantity + l_partkey % 5 > 27 THEN 'large' ELSE 'small' END", "lineitem")),
    "filled_values": (
        _prepared,
        f"SELECT 'balance' AS feature, CAST(round(avg(balance), 2) AS VARCHAR) AS filled_with FROM ({CUSTOMER_WITH_GAPS}) "
        f"UNION ALL SELECT 'segment', segment FROM (SELECT segment, count(*) AS n FROM ({CUSTOMER_WITH_GAPS}) WHERE segment IS NOT NULL GROUP BY 1 ORDER BY n DESC, segment LIMIT 1)",
    ),
    "anomalies_far_out": (_far_out, "SELECT o_orderkey FROM orders WHERE o_orderkey % 500 = 0"),
    "class_counts": (
        lambda spark, folder: class_counts(customer_with_gaps(spark, folder), "segment"),
        f"SELECT segment AS label, count(*) AS n FROM ({CUSTOMER_WITH_GAPS}) g WHERE segment IS NOT NULL GROUP BY 1",
    ),
    "split_counts": (_split_counts, SPLIT_SQL),
    "train_logistic_regression": (_metrics("classification", "size", "logistic_regression"), None),
    "train_forest_classifier": (_metrics("classification", "size", "random_forest"), None),
    "confusion_matrix": (
        lambda spark, folder: _train("classification", "size")(spark, folder).confusion_frame(), None
    ),
    "train_linear_regression": (_metrics("regression", "score", "linear_regression"), None),
    "train_forest_regressor": (_metrics("regression", "score", "random_forest"), None),
    "train_boosted_regressor": (_metrics("regression", "score", "gradient_boosting"), None),
    "feature_importance": (
        lambda spark, folder: _train("regression", "score")(spark, folder).importance_frame(), None
    ),
    "train_kmeans": (_metrics("clustering", features=FEATURES[:3], n_clusters=4), None),
    "cluster_sizes": (
        lambda spark, folder: _train("clustering", features=FEATURES[:3])(spark, folder).clusters_frame(), None
    ),
    "train_isolation_forest": (_metrics("anomaly_detection", features=FEATURES[:3]), None),
    "anomalies": (_anomaly_count, None),
}
