"""Spreadsheet workbooks (.xlsx): a folder of them is one job, one workbook per task.

A workbook is a zip of XML parts and cannot be split; the size cap of the file check bounds a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscope.errors import ValidationError
from columnscope.functions.columns import ROW_ID

_ROWS_PER_BATCH = 20_000
_SCHEMA = "file string, row long, cells array<string>, problem string"
# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47})


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in root]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles whose number format is a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom, found = set(), set()
    for node in root.iter():
        if _local(node.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", node.get("formatCode", ""))
            if re.search(r"[ymdhs]", code, re.IGNORECASE):
                custom.add(int(node.get("numFmtId")))
    for node in root:
        if _local(node.tag) == "cellXfs":
            for i, style in enumerate(node):
                fmt = int(style.get("numFmtId", 0))
                if fmt in DATE_FORMATS or fmt in custom:
                    found.add(i)
    return found


def _first_sheet(book: zipfile.ZipFile) -> str:
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in relations}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(n for n in root.iter() if _local(n.tag) == "sheet")
    key = next(v for k, v in sheet.attrib.items() if _local(k) == "id" and "}" in k)
    target = targets[key]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _value(cell, texts: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    raw = next((n.text for n in cell if _local(n.tag) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind in ("str", "d"):
        return raw
    number = float(raw)
    if int(cell.get("s", 0)) in dates:
        # Day 0 is 1899-12-30 for every date after February 1900.
        return (datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400))).isoformat(sep=" ")
    return str(int(number)) if number.is_integer() and abs(number) < 2**53 else repr(number)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet, each a list of cell texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts, dates = _texts(book), _date_styles(book)
        with book.open(_first_sheet(book)) as part:
            for _, node in ElementTree.iterparse(part):
                if _local(node.tag) != "row":
                    continue
                cells: list[str | None] = []
                for cell in node:
                    at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(cell, texts, dates)
                node.clear()
                yield cells


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            number = 0
            try:
                for cells in sheet_rows(bytes(content)):
                    rows.append((path, number, cells, None))
                    number += 1
                    if len(rows) == _ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=["file", "row", "cells", "problem"])
                        rows = []
            except Exception as e:  # any damage inside the file is that file's problem, reported with its name
                rows = [(path, number, None, f"{type(e).__name__}: {e}")]
            if rows:
                yield pd.DataFrame(rows, columns=["file", "row", "cells", "problem"])


def _typed(table: DataFrame, names: list[str]) -> DataFrame:
    """Give each text column the narrowest type all its values fit."""
    kinds = ("bigint", "double", "boolean", "timestamp")
    exprs = [F.count(f"c{i}").alias(f"c{i}_all") for i in range(len(names))]
    for i in range(len(names)):
        exprs += [F.count(F.col(f"c{i}").try_cast(k)).alias(f"c{i}_{k}") for k in kinds]
    row = table.agg(*exprs).first()
    columns = []
    for i, name in enumerate(names):
        filled = row[f"c{i}_all"]
        kind = next((k for k in kinds if filled and row[f"c{i}_{k}"] == filled), "string")
        columns.append(F.col(f"c{i}").cast(kind).alias(name))
    return table.select(*columns, ROW_ID)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of all workbooks under ``path``, stacked; they must share one header row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    total = files.select("path").count()
    if not total:
        raise ValidationError(f"No workbooks found at {path!r}.")
    cells = files.repartition(total, "path").mapInPandas(_parse, _SCHEMA)
    problems = cells.where("problem is not null").select("file", "problem").limit(5).collect()
    if problems:
        raise ValidationError(
            f"Could not read Excel file: {problems[0]['problem']}", details={p["file"]: p["problem"] for p in problems}
        )
    headers = [r["cells"] for r in cells.where("row = 0").select("cells").distinct().limit(2).collect()]
    if not headers or not any(headers[0]):
        raise ValidationError("No columns detected in file.")
    if len(headers) > 1:
        raise ValidationError("The workbooks do not share one header row.")
    names = [h if h else f"Unnamed: {i}" for i, h in enumerate(headers[0])]
    sizes = {r["file"]: r["n"] for r in cells.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("n")).collect()}
    starts, start = [], 0
    for file in sorted(sizes):  # one entry per workbook
        starts.append((file, start))
        start += sizes[file]
    offsets = spark.createDataFrame(starts, "file string, start long")
    body = (
        cells.where("row > 0").join(offsets, "file")
        .select(
            *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(names))],
            (F.col("start") + F.col("row") - 1).alias(ROW_ID),
        )
    )
    return _typed(body, names)
