"""Documents drawn from a tree of sources so that token shares follow target weights.

Leaves of the tree (say domain, language, source) hold documents; a leaf can give its tokens ``max_epochs`` times. The
budget goes down from the root: a node shares what it gets among its children by their weights, and what a child cannot use is
shared again among its siblings. As a child's room is that of its whole subtree, a shortage is made good among siblings as
long as they have room and goes up to the ancestors' other children only then. All amounts are whole tokens and exact.

A leaf then gives whole epochs and a prefix of one more: each epoch has an order of its own, by a seeded hash, and the
last document is cut where the budget ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from columnscope.llm.storage import materialise

# Documents of a leaf are summed by ranges of their hash of about so many rows; only the range in which the budget ends is ordered.
RANGE_ROWS = 1024
# A table of leaves with at most so many rows is sent to all tasks; a longer one is joined by a shuffle.
BROADCAST_LEAVES = 10_000
_WIDE = "decimal(38,0)"
Weights = Mapping[str | tuple[str, ...], int]


def _node(levels: Sequence[str]) -> Column:
    """One text for a node's path; a null is told from every value."""
    return F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in levels])


def _weight(levels: Sequence[str], weights: Weights, default: int) -> Column:
    """Weight of a node: by its whole path, else by its own value, else ``default``."""
    own = F.col(f"`{levels[-1]}`").cast("string")
    found = [
        F.when(F.array(*[F.col(f"`{c}`").cast("string") for c in levels]) == F.array(*[F.lit(v) for v in key]), F.lit(w))
        for key, w in weights.items() if isinstance(key, tuple) and len(key) == len(levels)
    ] + [F.when(own == key, F.lit(w)) for key, w in weights.items() if isinstance(key, str)]
    return F.coalesce(*found, F.lit(default)).cast("long")


def _shared(nodes: DataFrame) -> DataFrame:
    """Adds ``given``: what each node gets of its parent's ``budget`` by ``weight``, at most its ``room``.

    Children are looked at in order of room per weight. One is filled if its room is at most its share of what those before it
    left; from the first that is not, all share the rest by weight, whole tokens first and the remainder one by one.
    """
    order = Window.partitionBy("parent").orderBy((F.col("room").cast("double") / F.col("weight")), "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = nodes.where("weight > 0 and room > 0").withColumn("left", F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0)))
    n = n.withColumn("weights", F.sum("weight").over(Window.partitionBy("parent")) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    n = n.withColumn("open", F.expr(f"cast(room as {_WIDE}) * weights > cast(weight as {_WIDE}) * left"))
    for name, column in (("rest", "left"), ("by", "weights")):
        n = n.withColumn(name, F.first(F.when(F.col("open"), F.col(column)), ignorenulls=True).over(whole))
    n = n.withColumn("is_open", F.coalesce(F.max("open").over(order), F.lit(False)))
    n = n.withColumn("share", F.expr(f"case when is_open then cast(cast(weight as {_WIDE}) * rest div by as long) else room end"))
    n = n.withColumn("shared", F.sum(F.when(F.col("is_open"), F.col("share"))).over(whole))
    rank = F.sum(F.col("is_open").cast("long")).over(order)
    return n.withColumn("rank", rank).withColumn(
        "given", F.col("share") + F.when(F.col("is_open") & (F.col("rank") <= F.col("rest") - F.col("shared")), 1).otherwise(0)
    ).select(*nodes.columns, "given")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], budget: int, weights: Weights, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """``leaves`` (the level columns and ``tokens``) with ``given``, the tokens each is to give; leaves that give none are left out."""
    tree = leaves.withColumn("room", F.col("tokens") * max_epochs)
    parents = tree.agg(F.least(F.coalesce(F.sum("room"), F.lit(0)), F.lit(int(budget))).alias("budget")).withColumn("parent", F.lit(""))
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        nodes = tree.groupBy(*path).agg(F.sum("room").alias("room"))
        nodes = nodes.select(
            *path, "room", _node(path).alias("node"), (_node(path[:-1]) if depth > 1 else F.lit("")).alias("parent"),
            _weight(path, weights, default_weight).alias("weight"),
        ).join(parents, "parent")
        given = materialise(_shared(nodes).select("node", "given"))
        parents = given.select(F.col("node").alias("parent"), F.col("given").alias("budget"))
    return tree.drop("room").withColumn("leaf", _node(levels)).join(given.withColumnRenamed("node", "leaf"), "leaf").where("given > 0")


def mix(df: DataFrame, levels: Sequence[str], tokens: str, budget: int | float, weights: Weights, *, id: str = "doc_id",
        max_epochs: int = 4, seed: int = 0, default_weight: int = 1) -> DataFrame:
    """Rows of ``df`` with all their columns, and ``epoch`` (from 0) and ``taken`` (tokens of the row to use in it).

    ``budget`` is a number of tokens, or a float that is a share of all tokens. A row comes once for every epoch that
    uses it. ``weights`` are whole numbers by value of a level or by whole path, ``default_weight`` elsewhere; weight 0
    gives nothing. A null level value is a group of its own, null or negative ``tokens`` count as 0. Rows without tokens
    go with their leaf's order; a leaf without any tokens gives nothing. Rows with equal ids stand together in the
    order, by the hash of their tokens and level. An empty table or budget gives no rows. ``epoch`` and ``taken``
    replace columns of these names.

    A leaf may hold any share of the rows: its prefix is found from sums over ranges of the hash, and only the range where the
    budget ends is put in order.
    """
    held = df.withColumn("__tokens", F.greatest(F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long"), F.lit(0))).withColumn("__leaf", _node(levels))
    leaves = materialise(held.groupBy(*[F.col(f"`{c}`") for c in levels]).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("rows")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    amount = int(total * budget) if isinstance(budget, float) else int(budget)
    plan = leaf_budgets(leaves, levels, amount, weights, max_epochs, default_weight)
    # the hash's first digits cut a leaf into ranges; their number follows from the leaf's rows
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("rows") / RANGE_ROWS))).cast("int")
    plan = materialise(plan.select(
        F.col("leaf").alias("__leaf"), F.expr("cast(given div tokens as int)").alias("__full"), (F.col("given") % F.col("tokens")).alias("__rest"), digits.alias("__digits")
    ))
    keyed = _to_leaves(held, plan).withColumn(
        "__order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__full").cast("string"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))))
    ).withColumn("__range", F.expr("substr(__order, 1, __digits)"))
    ranges = keyed.where("__rest > 0").groupBy("__leaf", "__range").agg(F.sum("__tokens").alias("n"))
    until = F.sum("n").over(Window.partitionBy("__leaf").orderBy("__range"))
    ends = materialise(
        ranges.join(plan.select("__leaf", "__rest"), "__leaf").withColumn("until", until).withColumn("__before", F.col("until") - F.col("n"))
        .where("__before < __rest and until >= __rest").select("__leaf", F.col("__range").alias("__end"), "__before")
    )
    placed = _to_leaves(keyed, ends, "left")
    whole = placed.withColumn("__last", F.when(F.expr("__range < __end"), F.col("__full")).otherwise(F.col("__full") - 1)).where("__last >= 0")
    whole = whole.withColumn("__epoch", F.explode(F.expr("sequence(0, __last)"))).withColumn("__taken", F.col("__tokens"))
    order = Window.partitionBy("__leaf").orderBy("__order", F.xxhash64("__tokens", *[F.col(f"`{c}`") for c in levels]))
    start = F.sum("__tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    edge = placed.where("__range = __end").withColumn("__start", F.col("__before") + F.coalesce(start, F.lit(0))).where("__start < __rest")
    edge = edge.withColumn("__epoch", F.col("__full")).withColumn("__taken", F.least("__tokens", F.col("__rest") - F.col("__start")))
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("epoch", "taken")] + [F.col("__epoch").alias("epoch"), F.col("__taken").alias("taken")]
    return whole.select(*columns).unionAll(edge.select(*columns))


def _to_leaves(rows: DataFrame, leaves: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to a table of leaves, which is sent to all tasks only where it is short."""
    return rows.join(F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves, "__leaf", how)


def cut_to(text: Column, words: Column) -> Column:
    """The first ``words`` words of a text, with what stands between them."""
    pieces = F.split(text, r"(?<=[ \t-\r])(?=[^ \t-\r])")
    lead = F.when(text.rlike(r"^[ \t-\r]"), 1).otherwise(0)
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int") + lead), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
