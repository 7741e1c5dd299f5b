"""Files with quoted line breaks, cut into many splits, against the csv module."""

from __future__ import annotations

import csv
import io
import random

import pytest

from columnscope.sources import quoted
from columnscope.sources.files import ingest, read_delimited, read_table


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def written(path, rows, sep=",", end="\n", encoding="utf-8"):
    text = io.StringIO(newline="")
    csv.writer(text, delimiter=sep, lineterminator=end).writerows(rows)
    path.write_bytes(text.getvalue().encode(encoding))


@pytest.mark.parametrize("end, encoding, sep", [("\n", "utf-8", ","), ("\r\n", "utf-8", ";"), ("\n", "latin-1", "|")])
def test_records_of_many_splits(spark, tmp_path, small_splits, end, encoding, sep):
    rng = random.Random(5)
    texts = ["plain", 'say "x"', "a\nb", "\n\n", 'six " or\nseven', f'"{sep} "', f'"\n"{sep}"', "é\r\nz", "many\n" * 300, ""]
    rows = [[i, rng.choice(texts), rng.randint(0, 9)] for i in range(300)]
    written(tmp_path / "a.csv", [["i", "t", "x"], *rows], sep, end, encoding)
    found = quoted.records(spark, [str(tmp_path / "a.csv")], sep, "UTF-8" if encoding == "utf-8" else "ISO-8859-1")
    assert found.select("block").distinct().count() > 8
    got = [r["record"] for r in found.where("not header").orderBy("block", "place").collect()]
    assert [next(csv.reader(io.StringIO(r, newline=""), delimiter=sep)) for r in got] == [[str(c) for c in row] for row in rows]
    stored = read_table(spark, ingest(spark, str(tmp_path / "a.csv"), str(tmp_path / "out")).path)
    assert [(r["_row_id"], r["i"], r["t"] or "", r["x"]) for r in stored.orderBy("_row_id").collect()] == [(n, i, t, x) for n, (i, t, x) in enumerate(rows)]
    assert dict(stored.dtypes)["i"] == "int" and dict(stored.dtypes)["x"] == "int"


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    written(tmp_path / "a.csv", [["i", "t"], *([i, "x\ny"] for i in range(2000))])
    table = read_delimited(spark, str(tmp_path / "a.csv"), numbered=False)
    assert table.count() == 2000
    assert quoted._lines(spark, [str(tmp_path / "a.csv")]).rdd.getNumPartitions() > 8


def test_rule():
    rule = quoted.LineRule(",")
    def both(line):
        return rule.ends_inside(line, False), rule.ends_inside(line, True)

    assert both(b"a,b") == (False, True) and both(b'a,"b') == (True, True) and both(b'b",c') == (False, False)
    assert both(b'5" pipe,x') == (False, True) and both(b'5" pipe,"open') == (True, True) and both(b'"a","b"\r') == (False, True)
    assert both(b'end","new') == (True, True)
    assert both(b'"start "",""') == (True, True) and both(b'""""') == (False, True) and both(b'"') == (True, False)


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('t,n\n"a\nb",1\n\n5" pipe,2\n"open\nto the end,3')
    rows = [tuple(r) for r in read_delimited(spark, str(tmp_path / "a.csv")).select("t", "n", "_row_id").orderBy("_row_id").collect()]
    assert rows == [("a\nb", 1, 0), ('5" pipe', 2, 1), ("open\nto the end,3", None, 2)]
    (tmp_path / "a.csv").write_text('"t\nu",n\n"a\nb",1\n')
    assert read_delimited(spark, str(tmp_path / "a.csv")).select("`t\nu`", "n").collect()[0][:] == ("a\nb", 1)


def test_query_writes_a_large_table_to_several_files(spark, tmp_path, monkeypatch):
    from columnscope.plans import tables

    monkeypatch.setattr(tables, "BREAKS_BYTES", 4000)
    rows = [(i, "en", f'line {i}\nsays "{i * 7919}"' * 20, 10) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars int").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    places = []
    place = tables._place
    monkeypatch.setattr(tables, "_place", lambda s, n: places.append(place(s, n)) or places[-1])
    got = {r["doc_id"]: r["n"] for r in tables._with_breaks(spark, str(tmp_path)).collect()}
    assert got == {i: len(t) for i, _, t, _ in rows}
    assert len(spark.read.format("binaryFile").load(f"{places[0]}/in/*.csv").inputFiles()) > 2


def test_query_reads_files_that_begin_with_other_separators(spark, tmp_path, monkeypatch):
    from columnscope.plans import tables

    monkeypatch.setattr(tables, "BREAKS_BYTES", 4000)
    rows = [(i, "en", f"{i * 7919} | a | b\n| c | d ; e" * 20, 10) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars int").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["n"] for r in tables._with_breaks(spark, str(tmp_path)).collect()} == {i: len(t) for i, _, t, _ in rows}
