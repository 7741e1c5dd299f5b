from __future__ import annotations

import random

from pyspark.sql import functions as F

from columnscope.llm import mixing, url_filter
from columnscope.llm.components import components
from columnscope.llm.url_filter import UrlRule

RULES = (UrlRule("bad.org", "/", "block"), UrlRule("good.bad.org", "/", "allow"), UrlRule("bad.org", "/x/", "block"))


def judged(spark, pages, **more):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, RULES, **more).collect()}


def test_aliases(spark):
    pages = [
        (1, "http://BAD.org/a?q", None), (2, "https://alias.net/1", '<LINK href="http://bad.org/a?q" rel=canonical>'),
        (3, "https://good.bad.org/y", '<link rel="canonical" href="http://bad.org/z">'), (4, "https://far.net", "<meta http-equiv='refresh' content='0; url=https://alias.net/1#top'>"),
        (5, "https://clean.net/", "<p>canonical refresh</p>"), (6, None, None), (7, "no scheme", "<link rel=canonical href=http://bad.org/>"), (8, "http://rel.net/d/p", '<link rel="canonical" href="../q">'),
        (1, "http://BAD.org/a?q", None),
    ]
    found = judged(spark, pages)
    assert found[1] == ("bad.org", "/a", "bad.org/", "block")
    assert found[2][2:] == (None, "block") and found[4][2:] == (None, "block")
    assert found[3][2:] == ("good.bad.org/", "allow") and found[5][3] == "allow" and found[8][3] == "allow"
    assert found[6] == found[7] == ("", "", None, "allow")
    redirects = spark.createDataFrame([("https://clean.net/", "http://u.net/"), ("http://u.net/", "http://bad.org/x/1"), (None, "http://bad.org/")], "source string, target string")
    assert judged(spark, pages, redirects=redirects)[5][3] == "block"
    assert judged(spark, []) == {}


def test_markup(spark):
    long = "x" * 9000
    pages = [
        ("http://a.org/1", '<link title="a > b" rel="canonical" href="http://t.org/1">'), ("http://a.org/2", f'<link data-x="{long}" rel=canonical href=http://t.org/2>'),
        ("http://a.org/3", '<link rel="alternate canonical" href="/q">'), ("http://a.org/4", '<!-- <link rel=canonical href="http://t.org/4"> -->'),
        ("http://a.org/d/e/5", "<link href='../q/./z/..?x=../y' rel='canonical'>"), ("http://a.org/6", '<link title="rel=canonical" href="http://t.org/6">'),
        ("http://a.org/7", "<!-- open <link rel=canonical href=http://t.org/7>"), ("http://a.org/8", '<META content="5; URL=\'http://t.org/8?a=1&amp;b=2\'" HTTP-EQUIV=Refresh>'),
        ("http://a.org/9", "<link title=Bob's rel=canonical href=http://t.org/9>"), ("http://a.org/../../10/.", "<link rel=canonical href=http://t.org>"),
        ("http://a.org/11", "<link " + "'" * 3001), ("http://a.org/12", "<link rel='canonicals' href='http://t.org/12'>"),
    ]
    found = url_filter.page_links(spark.createDataFrame([(*p, 1, "k", "t") for p in pages], "url string, html string, source int, kind string, tag string"))
    assert {(r.source, r.target) for r in found.collect()} == {
        ("http://a.org/1", "http://t.org/1"), ("http://a.org/2", "http://t.org/2"), ("http://a.org/3", "http://a.org/q"), ("http://a.org/d/e/5", "http://a.org/d/q/?x=../y"),
        ("http://a.org/8", "http://t.org/8?a=1&b=2"), ("http://a.org/9", "http://t.org/9"), ("http://a.org/10/", "http://t.org/"),
    }


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(7, None), (5000, 5000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in found.collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def filled(room, weight, budget):
    """What each child gets, by pouring until nothing changes."""
    given, open_ = dict.fromkeys(room, 0.0), set(room)
    left = float(min(budget, sum(room.values())))
    while left > 1e-9 and open_:
        total = sum(weight[k] for k in open_)
        for k in list(open_):
            given[k] += left * weight[k] / total
        over = {k for k in open_ if given[k] >= room[k] - 1e-9}
        left = sum(given[k] - room[k] for k in over)
        for k in over:
            given[k] = float(room[k])
        open_ -= over
    return given


def test_budgets(spark):
    rows = [("a", "x", 100), ("a", "y", 10), ("b", "x", 5), ("b", "z", 3), ("c", None, 1000), (None, "x", 7)]
    leaves = spark.createDataFrame(rows, "d string, l string, tokens long")
    weights = {"a": 5, "b": 4, "x": 3, ("c", None): 2}
    found = {(r.d, r.l): r.given for r in mixing.leaf_budgets(leaves, ["d", "l"], 300, {k: v for k, v in weights.items() if k != ("c", None)}, 2).collect()}
    top = filled({"a": 220, "b": 16, "c": 2000, None: 14}, {"a": 5, "b": 4, "c": 1, None: 1}, 300)
    assert sum(found.values()) == 300
    for (d, l), given in found.items():
        room = {k[1]: 2 * k[2] for k in rows if k[0] == d}
        assert abs(given - filled(room, {k: 3 if k == "x" else 1 for k in room}, top[d])[l]) <= 2


def test_prefixes(spark):
    rng = random.Random(3)
    rows = [(i, "big" if i % 3 else "small", rng.choice([0, 1, 5, 30, None])) for i in range(5000)] + [(7, "small", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumn("epoch", F.lit("clash"))
    total = {s: sum(r[2] or 0 for r in rows if r[1] == s) for s in ("big", "small")}
    budget = total["small"] * 3
    found = mixing.mix(df, ["source"], "n", budget, {"big": 1, "small": 2}, max_epochs=3, seed=4)
    assert set(found.columns) == set(df.columns) | {"taken"}
    got = {r.source: r.taken for r in found.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    assert sum(got.values()) == budget and got["small"] == 2 * total["small"]
    again = mixing.mix(df.repartition(7), ["source"], "n", budget, {"big": 1, "small": 2}, max_epochs=3, seed=4)
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    assert mixing.mix(df.limit(0), ["source"], "n", 0.5, {}).count() == 0


def test_cut(spark):
    row = spark.createDataFrame([("  a bb\n\tc  d", "a b")], "x string, y string").select(
        mixing.cut_to(F.col("x"), F.lit(2)).alias("x"), mixing.cut_to(F.col("y"), F.lit(1)).alias("y"), mixing.n_words(F.col("x")).alias("n")).first()
    assert row.x.split() == ["a", "bb"] and row.x.startswith("  a bb") and row.y.strip() == "a" and row.n == 4
