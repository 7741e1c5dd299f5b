"""Delimited files and workbooks: validation, delimiter and encoding detection, scan, ingest."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnscope.errors import UnsupportedFileError, ValidationError
from columnscope.functions.columns import ROW_ID, normalise_missing, ref
from columnscope.sources import quoted
from columnscope.sources.workbook import read_workbooks

# Accepted kinds, size cap, separators in order of preference.
DEFAULT_EXTENSIONS = ("csv", "xlsx", "xls")
DELIMITED = ("csv", "tsv", "txt")
WORKBOOKS = ("xlsx",)
MAX_BYTES = 200 * 1024 * 1024
DELIMITERS = (",", "\t", ";", "|")
SNIFF_CHARS = 8192
# A quoted field begins after any separator or at the start of a line; one that the start of a file cuts off has no end.
_QUOTED = r'(?:\A|(?<=[,\t;|\n]))"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
_CORRUPT = "_corrupt_record"
_WIDE = "__too_wide"


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _plain_path(uri: str) -> str:
    """A listed file's URI in the spelling of the ``path`` column."""
    return re.sub(r"^file:/+", "file:/", unquote(uri))


def check_files(
    spark: SparkSession, path: str, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, max_bytes: int | None = MAX_BYTES
) -> DataFrame:
    """``path, length, extension, accepted, reason`` from file metadata alone (no content is read)."""
    listed = spark.read.format("binaryFile").load(path)
    # Empty files are listed but yield no row.
    names = spark.createDataFrame([(_plain_path(f),) for f in listed.inputFiles()], "path string")
    files = names.join(listed.select("path", "length"), "path", "left").fillna(0, "length")
    extension = _extension(F.col("path"))
    shown = F.when(extension == "", F.lit("(none)")).otherwise(extension)
    reason = F.when(~extension.isin(list(extensions)), F.concat(F.lit("Files of kind ."), shown, F.lit(" are not taken.")))
    reason = reason.when(F.col("length") <= 0, F.lit("The file is empty."))
    if max_bytes is not None:
        reason = reason.when(
            F.col("length") > max_bytes, F.lit(f"The file exceeds the limit of {max_bytes} bytes.")
        )
    return files.select("path", "length", extension.alias("extension"), reason.alias("reason")).withColumn(
        "accepted", F.col("reason").isNull()
    )


def _separator(start: Column) -> Column:
    """The separator of the text a file starts with, by what stands outside quoted fields: one found equally often in every line, else
    the most frequent, the one listed first among equals. Only where none stands outside do quoted fields count.
    """
    outside = F.regexp_replace(start, _QUOTED, '""')
    lines = F.filter(F.split(outside, "\n"), lambda line: F.trim(line) != "")
    whole = F.when((F.length(start) >= SNIFF_CHARS) & (F.size(lines) > 1), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)

    def count(text: Column, d: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(d)))

    bare = F.length(F.translate(outside, "".join(DELIMITERS), "")) == F.length(outside)
    found = []
    for i, d in enumerate(DELIMITERS):
        per = F.transform(whole, lambda line, d=d: count(line, d))
        even = F.coalesce((F.array_min(per) == F.array_max(per)) & (F.array_min(per) > 0), F.lit(False))
        n = F.when(bare, count(start, d)).otherwise(count(outside, d))
        found.append(F.struct(even.alias("even"), n.alias("n"), F.lit(-i).alias("turn"), F.lit(d).alias("delimiter")))
    return F.array_max(F.array(*found))["delimiter"]


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The separator by the start of a file (see ``_separator``); ``.tsv`` is always tab-separated."""
    if path.lower().endswith(".tsv"):
        return "\t"
    lines = spark.read.text(path).select(F.substring("value", 1, SNIFF_CHARS)).head(2048)
    start = "\n".join(row[0] for row in lines)[:SNIFF_CHARS]
    return spark.range(1).select(_separator(F.lit(start))).first()[0]


def _heads(lines: DataFrame) -> DataFrame:
    """``file, delimiter`` by the start of every file; lines past the first 2,048 of a file are dropped task by task."""
    first = W.partitionBy("file").orderBy("place")
    heads = (
        lines.where("block = 0").select("file", "place", F.substring("value", 1, SNIFF_CHARS).alias("value"))
        .withColumn("nth", F.row_number().over(first)).where("nth <= 2048")
        .groupBy("file").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda r: r["value"]), "\n"), 1, SNIFF_CHARS).alias("start"))
    )
    return heads.select("file", F.when(F.lower("file").endswith(".tsv"), F.lit("\t")).otherwise(_separator(F.col("start"))).alias("delimiter"))


def layouts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, encoding, delimiter, quoted_breaks`` per file.

    UTF-8 if every line is valid UTF-8, else Latin-1. A line with an odd number of quotes begins or ends a quoted
    line break, so the records of such a file are not its lines.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    facts = lines.groupBy("file").agg(F.min(F.is_valid_utf8("value")).alias("valid"), F.max(odd).alias("quoted_breaks"))
    return facts.join(_heads(lines), "file").select(
        "file", F.when(F.col("valid"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding"), "delimiter", "quoted_breaks"
    )


def _common_schema(schemas: list[T.StructType]) -> T.StructType:
    """One type per column for files read apart: the same type, double for numbers, else text. Headers must agree."""
    names = schemas[0].names
    if any(s.names != names for s in schemas):
        raise ValidationError("The files have different headers.")
    fields = []
    for name in names:
        kinds = {s[name].dataType for s in schemas}
        kind = kinds.pop() if len(kinds) == 1 else T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds) else T.StringType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def _with_offsets(tagged: DataFrame) -> DataFrame:
    """Add ``_row_id`` in file order: start of the file block (counted once per block) + place in the block."""
    # One row per file block: the running count below is over blocks, not rows.
    blocks = tagged.groupBy("__file", "__block").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__file", "__block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("__file", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (
        tagged.join(starts, ["__file", "__block"])
        .withColumn(ROW_ID, F.col("__start") + F.col("__place") - F.col("__first"))
        .drop("__file", "__block", "__place", "__first", "__start")
    )


_CSV = dict(quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, nanValue="NaN")


def _inferred(spark: SparkSession, members: list[str], sep: str, encoding: str, records: DataFrame | None) -> T.StructType:
    """Column names and types by the reader's own rules, over all rows."""
    reader = spark.read.options(sep=sep, encoding=encoding, quote='"', escape='"', inferSchema=True)
    if records is None:
        return reader.option("header", True).csv(members).schema
    headers = [r["record"] for r in records.where("header").select("record").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValidationError("The files have different headers.")
    texts = getattr(records.where("not header").select("record")._jdf, "as")(spark._jvm.Encoders.STRING())
    kinds = T.StructType.fromJson(json.loads(reader._jreader.csv(texts).schema().json()))
    # the names come from the header, so that its rules (unnamed and repeated columns) are the reader's too
    header = getattr(spark.createDataFrame([(h,) for h in headers], "record string")._jdf, "as")(spark._jvm.Encoders.STRING())
    names = T.StructType.fromJson(json.loads(reader.option("header", True)._jreader.csv(header).schema().json())).names
    return T.StructType([T.StructField(n, kinds[i].dataType if i < len(kinds) else T.StringType()) for i, n in enumerate(names)])


def scan_delimited(spark: SparkSession, paths: list[str], delimiter: str, encoding: str, schema: T.StructType, records: DataFrame | None = None) -> DataFrame:
    """The rows of files of one layout with the malformed text, and the file, file block and place of each."""
    full = schema.add(_CORRUPT, "string") if _CORRUPT not in schema.names else schema
    if records is None:
        scan = spark.read.options(header=True, sep=delimiter, encoding=encoding, columnPruning=False, **_CSV).schema(full).csv(paths)
        place = (F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__place"))
        return scan.select("*", *place)
    parsed = F.from_csv("record", full.toDDL(), {"sep": delimiter, **_CSV})
    return records.where("not header").select(parsed.alias("row"), "file", "block", "place").select(
        "row.*", F.col("file").alias("__file"), F.col("block").alias("__block"), F.col("place").alias("__place")
    )


def read_delimited(
    spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool | None = None, numbered: bool = True
) -> DataFrame:
    """All delimited files under ``path`` as one table with ``_row_id``.

    Encoding, delimiter (unless given) and quoted line breaks (unless ``multi_line`` is given) are found file by
    file; files of one layout are read together, and all get the same column types.
    """
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]
    if not files:
        raise ValidationError(f"No files found at {path!r}.")
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for row in layouts(spark, files).orderBy("file").collect():  # one row per file
        whole = row["quoted_breaks"] if multi_line is None else multi_line
        groups.setdefault((row["encoding"], delimiter or row["delimiter"], whole), []).append(row["file"])
    if not groups:
        raise ValidationError("The file is empty.")
    parts = []
    try:
        records = {key: quoted.records(spark, members, key[1], key[0]) if key[2] else None for key, members in groups.items()}
        schemas = [_inferred(spark, members, key[1], key[0], records[key]) for key, members in groups.items()]
        schema = _common_schema(schemas) if len(schemas) > 1 else schemas[0]
        for key, members in groups.items():
            parts.append(scan_delimited(spark, members, key[1], key[0], schema, records[key]).withColumn("__sep", F.lit(key[1])))
    except AnalysisException as e:
        raise ValidationError(f"The files cannot be read as delimited text: {e}") from e
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    names = [c for c in table.columns if c not in (_CORRUPT, "__file", "__block", "__place", "__sep")]
    if not names:
        raise ValidationError("The files have no columns.")
    # A short row is padded with NULLs; a row with more fields than the header is an error.
    fields = F.regexp_replace(ref(_CORRUPT), r'"[^"]*"', "")
    wide = ref(_CORRUPT).isNotNull() & (F.length(fields) - F.length(F.replace(fields, F.col("__sep"))) >= len(names))
    table = table.withColumn(_WIDE, F.coalesce(wide, F.lit(False))).drop("__sep")
    if not numbered:
        return table.drop("__file", "__block", "__place", _WIDE)
    return _with_offsets(table)


@dataclass(frozen=True)
class Ingested:
    path: str
    row_count: int
    column_count: int


def ingest(
    spark: SparkSession, path: str, out: str, *, delimiter: str | None = None, multi_line: bool | None = None,
    extensions: tuple[str, ...] = (*DEFAULT_EXTENSIONS, "tsv", "txt"), max_bytes: int | None = None,
) -> Ingested:
    """Read delimited files or workbooks of one table and store them as Parquet at ``out``.

    Rows are checked before anything is written, so a table that is already at ``out`` survives a failed ingest; they
    are counted in what was written.
    """
    checked = check_files(spark, path, extensions, max_bytes)
    facts = checked.groupBy("extension", "reason").agg(F.count(F.lit(1)).alias("n")).collect()
    if not facts:
        raise ValidationError(f"No files found at {path!r}.")
    for row in facts:
        if row["reason"]:
            kind = UnsupportedFileError if row["reason"].startswith("Files of kind") else ValidationError
            raise kind(row["reason"], details={"allowed": sorted(extensions)})
    kinds = {row["extension"] for row in facts}
    if kinds <= set(DELIMITED):
        table = read_delimited(spark, path, delimiter, multi_line)
        # the reader looks at a whole row only if it is not asked for the malformed text alone
        bad = table.agg(F.count_if(F.col(_WIDE)).alias("bad"), F.count(ref(table.columns[0]))).first()["bad"]
        if bad:
            raise ValidationError(f"{bad} row(s) have more fields than the header.")
    elif kinds <= set(WORKBOOKS):
        table = read_workbooks(spark, path)
    else:
        raise UnsupportedFileError(f"Unsupported file extension(s): {sorted(kinds)}")
    names = [c for c in table.columns if c not in (_CORRUPT, _WIDE, ROW_ID)]
    normalise_missing(table.select(*[ref(n) for n in names], ROW_ID)).write.mode("overwrite").parquet(out)
    return Ingested(out, read_table(spark, out).count(), len(names))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; Catalyst prunes its columns and pushes filters."""
    return spark.read.parquet(path)
