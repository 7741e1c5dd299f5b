"""Records of delimited files whose quoted fields hold line breaks, from any number of splits of one file.

Whether a line begins inside a quoted field depends on everything before it, so such files are often read by one task. Here
each split of a file first tells where it would end if it began outside and if it began inside a field: four possible
answers, which compose. An exclusive scan over the splits of a file then gives the true beginning of each, and a second pass
cuts all splits into records at once. What a split holds of a record that began before it is joined on by its place.

A quote opens a field at the start of a line or after a separator only, and closes it before a separator or line end; doubled
quotes inside stand for one. Breaks are ``\\n`` or ``\\r\\n``. Blank lines outside fields are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from columnscope.functions.sizing import materialise

_BODY = rb'[^"]*+(?:""[^"]*+)*+"'


class LineRule:
    """Where a line ends, inside a quoted field or outside, by where it begins."""

    def __init__(self, separator: str):
        s = re.escape(separator.encode())
        self._close = re.compile(_BODY + rb"(?=" + s + rb"|\r?\Z)")
        self._field = re.compile(rb"(?:\A|(?<=" + s + rb'))"' + _BODY + rb"(?=" + s + rb"|\r?\Z)")
        self._open = re.compile(rb"(?:\A|(?<=" + s + rb'))"')

    def ends_inside(self, line: bytes, inside: bool) -> bool:
        if inside:
            closed = self._close.match(line)
            if closed is None:
                return True
            line = line[closed.end():]
        return b'"' in line and self._open.search(self._field.sub(b"", line)) is not None


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"), F.contains("value", F.lit('"')).alias("quoted"),
    )


def _beginnings(lines: DataFrame, separator: str) -> DataFrame:
    """(file, block) of the splits that begin inside a quoted field."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, found = LineRule(separator), {}
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line"))):
                file, block, line = key
                outside, inside = found.get((file, block), (False, True))
                found[file, block] = rule.ends_inside(line, outside), rule.ends_inside(line, inside)
        columns = zip(*((f, b, *ends) for (f, b), ends in found.items())) if found else ([],) * 4
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "outside", "inside"])

    # a line without quotes changes nothing, a split without any has no row
    by_split = lines.where("quoted").select("file", "block", "line").mapInArrow(ends, "file string, block long, outside boolean, inside boolean")
    splits = lines.groupBy("file", "block").agg(F.lit(0)).select("file", "block").join(by_split, ["file", "block"], "left").select(
        "file", "block", F.coalesce("outside", F.lit(False)).alias("outside"), F.coalesce("inside", F.lit(True)).alias("inside")
    )
    # a split that ends alike in both cases settles the matter; those after it keep that or turn it over
    order = W.partitionBy("file").orderBy("block")
    settled = splits.withColumn("settled", F.col("outside") == F.col("inside")).withColumn("turns", (F.col("outside") & ~F.col("inside")).cast("int"))
    epochs = settled.withColumn("epoch", F.sum(F.col("settled").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    within = W.partitionBy("file", "epoch").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    ended = epochs.withColumn("base", F.first(F.when(F.col("settled"), F.col("outside")).otherwise(F.lit(False))).over(within)).withColumn(
        "end", F.col("base").cast("int").bitwiseXOR((F.sum("turns").over(within) % 2).cast("int")) == 1
    )
    return ended.withColumn("begin", F.lag("end", 1, False).over(order)).where("begin").select("file", "block")


def records(spark: SparkSession, paths: list[str], separator: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, block, place, header, record): the records of the files; ``place`` counts those that begin in a split, without the header.

    The list of splits that begin inside a field goes to the tasks: two numbers for at most every split of the files.
    """
    lines = _lines(spark, paths)
    inside_at = spark.sparkContext.broadcast({(r["file"], r["block"]) for r in _beginnings(lines, separator).toLocalIterator()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = LineRule(separator)
        key, inside, held, kind, place, header = None, False, [], "whole", 0, False
        out: list[tuple] = []

        def emit(fragment: str) -> None:
            nonlocal place, header, held
            text = b"\n".join(held)
            held = []
            if fragment in ("whole", "tail"):
                text = text[:-1] if text.endswith(b"\r") and fragment == "whole" else text
                if fragment == "whole" and not text.strip():
                    return
                out.append((*key, None if header else place, fragment, text))
                place, header = place + (not header), False
            else:
                out.append((*key, None, fragment, text))

        def table() -> pa.RecordBatch:
            columns = zip(*out) if out else ([],) * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "place", "kind", "record"])
            out.clear()
            return made

        def close_split() -> None:
            if held:
                emit("tail" if kind == "whole" else "middle")

        for batch in batches:
            for file, block, line, quoted in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line", "quoted"))):
                if (file, block) != key:
                    close_split()
                    key, place, header = (file, block), 0, block == 0
                    inside = key in inside_at.value
                    kind = "head" if inside else "whole"
                held.append(line)
                if quoted:
                    inside = rule.ends_inside(line, inside)
                if not inside:
                    emit(kind)
                    kind = "whole"
            yield table()
        close_split()
        yield table()

    found = materialise(lines.mapInArrow(cut, "file string, block long, place long, kind string, record binary"))
    # a record over several splits: its beginning (tail of a split), splits wholly inside it, and its end (head of a split)
    order = W.partitionBy("file").orderBy("block", F.col("kind") == "tail").rowsBetween(W.unboundedPreceding, 0)
    pieces = found.where("kind <> 'whole'").withColumn("number", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.hex("record").alias("record")))), lambda p: p["record"]), "0A")
    joined = pieces.groupBy("file", "number").agg(
        F.min("block").alias("block"), F.max("place").alias("place"), F.unhex(text).alias("record")
    ).select("file", "block", "place", "record")
    whole = found.where("kind = 'whole'").select("file", "block", "place", "record").unionAll(joined)
    shown = F.decode("record", encoding) if encoding != "UTF-8" else F.col("record").cast("string")
    return whole.select("file", "block", "place", F.col("place").isNull().alias("header"), F.rtrim(shown, F.lit("\r")).alias("record"))
