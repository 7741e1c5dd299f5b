from __future__ import annotations

import zipfile

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from columnscope.errors import UnsupportedFileError, ValidationError
from columnscope.operators.query import preview, run_query
from columnscope.operators.report import recommendation_list, report
from columnscope.operators.profile import profile
from columnscope.sources.files import check_files, detect_delimiter, ingest, layouts, read_table
from columnscope.sources.results import append_result, cached_profile, json_records, session_results, write_report

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, body, shared=("a", "b", "day")):
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        head = "".join(f'<c r="{chr(65 + i)}1" t="s"><v>{i}</v></c>' for i in range(len(shared)))
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData><row r="1">{head}</row>{body}</sheetData></worksheet>')


def test_csv_with_two_encodings(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes("name;n;x\nJosé;1;2.5\nÀb;2;\n".encode("latin-1"))
    (folder / "b.csv").write_bytes('name;n;x\nZoë;3;NaN\n"q;""x";4;1\nshort;5\n'.encode())
    got = ingest(spark, str(folder), str(tmp_path / "out"))
    assert (got.row_count, got.column_count) == (5, 3)
    rows = [tuple(r) for r in read_table(spark, got.path).orderBy("_row_id").collect()]
    assert rows == [("José", 1, 2.5, 0), ("Àb", 2, None, 1), ("Zoë", 3, None, 2), ('q;"x', 4, 1.0, 3), ("short", 5, None, 4)]


def test_row_numbers_follow_the_file(spark, tmp_path):
    """A file cut into many splits still gets dense numbers in file order."""
    (tmp_path / "big.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = ingest(spark, str(tmp_path / "big.csv"), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    stored = read_table(spark, got.path)
    assert stored.where("n <> _row_id").count() == 0
    # A page is a row-number range that reaches the Parquet reader.
    page = preview(stored, page=301, page_size=50)
    assert [r["n"] for r in page.collect()] == list(range(15000, 15050))
    assert "GreaterThanOrEqual(_row_id,15000)" in page._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text, delimiter", [
    ('a,b\n1,"x | y | z\n| | |"\n', ","), ('a,b\n1,"say ""|"" | | |, ;;;;;;"\n2,c', ","), ('"a;b;c",d\n"1;2;3",4', ","), ("a,b\n1,x | y | z\n2,z", ","),
    ('a,b\n1,"' + "x | y\n" * 2000 + '"\n', ","), ('a,b\n1,5" pipe\n2,6" pipe', ","), ('a|b\n1|"x, y, z"\n2|"x, y"', "|"), ('"a;b"\n"c;d"', ";"), ("", ","),
])
def test_delimiters_outside_quoted_fields(spark, tmp_path, text, delimiter):
    (tmp_path / "f.csv").write_text(text)
    assert detect_delimiter(spark, str(tmp_path / "f.csv")) == delimiter
    found = layouts(spark, [str(tmp_path / "f.csv")]).collect()
    assert [r["delimiter"] for r in found] == ([delimiter] if text else [])


@pytest.mark.parametrize("text, delimiter", [("a,b\n1,2", ","), ("a\tb\n1\t2", "\t"), ("a;b;c", ";"), ("a|b", "|"), ("a", ",")])
def test_delimiters(spark, tmp_path, text, delimiter):
    (tmp_path / "f.csv").write_text(text)
    assert detect_delimiter(spark, str(tmp_path / "f.csv")) == delimiter


def test_layouts_file_by_file(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("x,n\np,1\n")
    (folder / "b.csv").write_text("x;n\nq;2.5\n")
    (folder / "c.csv").write_text('x,n\n"a\nb",3\n"c,""d""",4\n')
    got = ingest(spark, str(folder), str(tmp_path / "out"))
    rows = [(r["x"], r["n"]) for r in read_table(spark, got.path).orderBy("_row_id").collect()]
    assert rows == [("p", 1.0), ("q", 2.5), ("a\nb", 3.0), ('c,"d"', 4.0)]
    (folder / "d.csv").write_text("x|m\np|1\n")
    with pytest.raises(ValidationError, match="headers"):
        ingest(spark, str(folder), str(tmp_path / "out"))
    (folder / "d.csv").write_text("x,n\np,1,2\n")
    with pytest.raises(ValidationError, match="more fields"):
        ingest(spark, str(folder), str(tmp_path / "out"))
    assert read_table(spark, got.path).count() == 4


def test_training_after_ingest(spark, tmp_path):
    from columnscope.operators.learning import train

    text = "a,b,kind,y\n" + "".join(f"{i % 17},{i % 5},{'uv'[(i % 17) > 8]},{3 * (i % 17) + i % 5}\n" for i in range(120))
    (tmp_path / "t.csv").write_text(text)
    table = read_table(spark, ingest(spark, str(tmp_path / "t.csv"), str(tmp_path / "o")).path)
    seen = Observation()
    table.observe(seen, F.count(F.lit(1)).alias("n")).count()
    for algorithm in ("logistic_regression", "random_forest"):
        assert train(table, "classification", ["a", "b"], "kind", algorithm).metrics["accuracy"] > 0.9
    for algorithm in ("linear_regression", "random_forest", "gradient_boosting"):
        assert train(table, "regression", ["a", "b"], "y", algorithm).metrics["r2"] > 0.9


def test_bad_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b\n1,2\n1,2,3\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "x.pdf").write_text("x")
    with pytest.raises(ValidationError, match="more fields"):
        ingest(spark, str(tmp_path / "wide.csv"), str(tmp_path / "o"))
    with pytest.raises(ValidationError, match="empty"):
        ingest(spark, str(tmp_path / "empty.csv"), str(tmp_path / "o"))
    with pytest.raises(UnsupportedFileError):
        ingest(spark, str(tmp_path / "x.pdf"), str(tmp_path / "o"))
    with pytest.raises(ValidationError, match="exceeds"):
        ingest(spark, str(tmp_path / "wide.csv"), str(tmp_path / "o"), max_bytes=3)
    reasons = {r["path"].rsplit("/", 1)[1]: r["accepted"] for r in check_files(spark, str(tmp_path)).collect()}
    assert reasons == {"wide.csv": True, "empty.csv": False, "x.pdf": False}


def test_workbooks(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    workbook(folder / "a.xlsx", '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c><c r="C2" s="1"><v>45658</v></c></row>')
    workbook(folder / "b.xlsx", '<row r="2"><c r="A2"><v>2</v></c><c r="C2" s="1"><v>45659.5</v></c></row>')
    got = ingest(spark, str(folder), str(tmp_path / "out"))
    rows = [(r["a"], r["b"], str(r["day"])) for r in read_table(spark, got.path).orderBy("_row_id").collect()]
    assert rows == [(1, "x", "2025-01-01 00:00:00"), (2, None, "2025-01-02 12:00:00")]
    (folder / "c.xlsx").write_text("junk")
    with pytest.raises(ValidationError, match="Excel"):
        ingest(spark, str(folder), str(tmp_path / "out2"))


def test_json_records(spark):
    df = spark.sql("select double('NaN') a, double('Infinity') b, 1.5d c, timestamp'2025-01-02 03:04:05' t, cast(null as int) n")
    assert json_records(df).first()["json"] == '{"a":null,"b":null,"c":1.5,"t":"2025-01-02T03:04:05","n":null}'


def test_result_log_and_profile_cache(spark, meters, tmp_path):
    log = str(tmp_path / "log")
    append_result(log, "s1", "table", {"q": 1}, run_query(meters, group_by=["model"], sort=dict(by="count")))
    append_result(log, "s1", "sql", {"q": 2}, meters.limit(1))
    append_result(log, "s2", "sql", {}, meters.limit(1))
    got = session_results(spark, log, "s1").collect()
    assert [r["kind"] for r in got] == ["table"] * 3 + ["sql"] and got[0]["result"] == '{"model":"K2","count":4}'
    with pytest.raises(ValidationError):
        append_result(log, "s1", "poem", {}, meters)

    cache = str(tmp_path / "profiles")
    first, hit = cached_profile(meters, cache, "meters")
    again, hit_again = cached_profile(meters, cache, "meters")
    assert (hit, hit_again) == (False, True) and again.columns == first.columns and again.summary == first.summary
    other, hit = cached_profile(meters.limit(2), cache, "meters", refresh=True)
    assert not hit and cached_profile(meters, cache, "meters")[0].summary["row_count"] == 2


def test_report(spark, boats, tmp_path):
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "old"), (2, 0, "user", "q"), (2, 1, "assistant", "new"), (2, 2, "tool", "t")], "conv_id long, turn long, role string, text string")
    got = report(boats, "boats.csv", 640, talk)
    row = got.first()
    assert row["assistant_message"] == "new" and row["summary"]["quality"]["overall"] == 86
    assert [c["kind"] for c in row["charts"]] == ["histogram", "bar", "line", "heatmap"]
    assert row["anomalies"][0]["outlier_count"] == 1 and len(row["anomalies"][0]["sample_rows"]) == 1
    assert row["executive_summary"].startswith("boats.csv - Rows: 14, columns: 6, bytes: 640, quality: 86 of 100")
    assert len(row["recommendations"]) == 3
    write_report(got, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    clean = profile(spark.createDataFrame(pd.DataFrame({"g": ["a", "b"] * 10, "v": [1.0, 2.0, 3.0, 4.0] * 5, "i": range(20)})))
    assert recommendation_list(clean)[0].startswith("Nothing needs to be done")
    alone = report(boats, "b", messages=talk.where("role = 'user'")).first()
    assert alone["assistant_message"] is None
