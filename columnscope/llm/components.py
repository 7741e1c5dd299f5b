"""Connected components of a graph given as a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.llm.storage import materialise

# So many rounds contract towards the smallest id, which ends at once where links point at a first member; later
# ones towards the smallest hash, which shortens any chain by a constant factor a round.
_ROUNDS_BY_ID = 2


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id reachable, itself included.

    Each round every node points at the smallest of itself and its neighbours, and links are carried over to what
    their ends point at; links within one node go. Groups combine before the shuffle, and no list of neighbours is
    ever built, so a node with very many links costs no more than as many links elsewhere. Each round is kept in the
    checkpoint folder. Links with a null end are left out; no links give no rows.
    """
    # a link to itself still names its node
    a, b = F.col(left), F.col(right)
    links = materialise(links.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    steps: list[DataFrame] = []
    while not links.isEmpty():
        if len(steps) < _ROUNDS_BY_ID:
            def key(c):
                return F.col(c)
        else:
            def key(c, seed=len(steps)):
                return F.struct(F.xxhash64(F.col(c), F.lit(seed)), F.col(c))
        both = links.select(F.col("a").alias("id"), F.explode(F.array("a", "b")).alias("to")).unionAll(
            links.select(F.col("b").alias("id"), F.explode(F.array("a", "b")).alias("to"))
        )
        points = materialise(both.groupBy("id").agg(F.min_by("to", key("to")).alias("to")))
        steps.append(points)
        moved = points.where("id <> to")
        links = materialise(
            links.join(moved.select(F.col("id").alias("a"), F.col("to").alias("a2")), "a", "left")
            .join(moved.select(F.col("id").alias("b"), F.col("to").alias("b2")), "b", "left")
            .select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = steps[0].select("id", F.col("to").alias("root"))
    for step in steps[1:]:
        step = step.where("id <> to").select(F.col("id").alias("root"), F.col("to").alias("next"))
        found = found.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    if len(steps) > 1:
        least = found.groupBy("root").agg(F.min("id").alias("component"))
        return materialise(found.join(least, "root").select("id", "component"))
    return found.select("id", F.col("root").alias("component"))
