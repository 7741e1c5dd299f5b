"""Deep pages against plain sorting."""

from __future__ import annotations

import random

import pytest

from columnscope.functions.columns import ROW_ID
from columnscope.operators import pages
from columnscope.operators.query import preview


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    names = [None, "", "a", "ab", "prefix that is long and shared 1", "prefix that is long and shared 2", "zebra", "Ärger", "東京"]
    rows = [(i, rng.choice([None, 7.5, 7.5, 7.5, rng.gauss(0, 5), float("nan"), -0.0]), rng.choice(names), rng.choice([True, False, None])) for i in range(1500)]
    return spark.createDataFrame(rows, f"{ROW_ID} long, x double, t string, b boolean").repartition(5)


@pytest.mark.parametrize("sort", ["x", "t", "b", None])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages(table, monkeypatch, sort, direction):
    monkeypatch.setattr(pages, "SHALLOW", 20)
    monkeypatch.setattr(pages, "RANGES", 8)
    held = [r.asDict() for r in table.collect()]
    for r in held:
        r["x"] = None if r["x"] is None or r["x"] != r["x"] else r["x"]

    def missing(r):
        return sort is not None and r[sort] is None

    held.sort(key=lambda r: r[ROW_ID])
    if sort:
        found = sorted([r for r in held if not missing(r)], key=lambda r: r[sort].encode() if sort == "t" else r[sort], reverse=False)
        if direction == "desc":
            groups: dict = {}
            for r in found:
                groups.setdefault(r[sort] + 0.0 if sort == "x" else r[sort], []).append(r)
            found = [r for key in reversed(list(groups)) for r in groups[key]]
        held = found + [r for r in held if missing(r)]
    for page in (3, 40, 76, 150, 151):
        got = [r[ROW_ID] for r in preview(table, page=page, page_size=10, sort=sort, sort_dir=direction, search=None if sort else "e").collect()]
        want = [r[ROW_ID] for r in held if sort or "e" in f"{r['t']}{str(r['b']).lower()}" and (("e" in (r["t"] or "")) or r["b"] is not None)]
        assert got == want[(page - 1) * 10:page * 10], (sort, page)


def test_no_deep_heap(spark):
    """What is left to the sort's offset stays small, however deep the page is."""
    wide = spark.range(200_000).selectExpr("id as _row_id", "pmod(hash(id), 1000) / 3.0 as x", "1 as same")
    for sort in ("x", "same"):
        rows, start = pages.skipped(wide, [(sort, False), (ROW_ID, False)], 150_000)
        assert start <= pages.SHALLOW
        want = wide.orderBy(sort, ROW_ID).offset(150_000).limit(3).collect()
        assert rows.orderBy(sort, ROW_ID).offset(start).limit(3).collect() == want
