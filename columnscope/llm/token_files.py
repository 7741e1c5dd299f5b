"""Token ids of documents in binary segments whose document boundaries are Elias-Fano encoded.

A segment is one binary value: a header, the boundaries of its documents, and their ids one after another. Boundaries
are a rising sequence of n + 1 numbers up to u, so that they take about n (2 + log2(u / n)) bits: the low
log2(u / n) bits of each are packed side by side, the high parts are one bits in a bit array, the i-th of them at
position high + i. A directory with the position of every 64th one bit gives any boundary after a look at a few words.

Segments are rows of Parquet files in a folder that Spark writes and reads, so any store that Spark reaches can
hold them; each row also says where its segment begins in the whole corpus.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnscope.llm.storage import only, per_worker

_MAGIC = b"EFTK"
_HEADER = "<4sBBHQQQQ"  # magic, version, bytes of an id, low bits, documents, ids, bytes of high bits, bytes of low bits
_DIRECTORY_STEP = 64
# A segment is closed once it holds so many ids (8 MB at two bytes).
SEGMENT_IDS = 1 << 22


def _packed(values: np.ndarray, width: int) -> bytes:
    """Numbers below 2^width as a little-endian bit string."""
    if not width:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode_boundaries(boundaries: np.ndarray) -> tuple[int, bytes, bytes, np.ndarray]:
    """Low width, high bits, low bits and directory of a rising sequence that starts at 0."""
    values = boundaries.astype(np.uint64)
    n, u = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (u // max(n, 1)).bit_length() - 1)
    places = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
    bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    bits[places.astype(np.int64)] = 1
    return width, np.packbits(bits, bitorder="little").tobytes(), _packed(values & np.uint64((1 << width) - 1), width), places[::_DIRECTORY_STEP]


class Boundaries:
    """Select over encoded boundaries: ``self[i]`` is the i-th, ``all()`` every one; no table of plain offsets is kept."""

    def __init__(self, n: int, width: int, high: np.ndarray, low: np.ndarray, directory: np.ndarray):
        self.n, self.width, self.high, self.low, self.directory = n, width, high, low, directory

    def _low(self, i: int) -> int:
        at = i * self.width
        piece = int.from_bytes(self.low[at >> 3:(at + self.width + 7) >> 3].tobytes(), "little")
        return piece >> (at & 7) & ((1 << self.width) - 1)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        rank, place = i % _DIRECTORY_STEP, int(self.directory[i // _DIRECTORY_STEP])
        at, left = place >> 3, rank + bin(int(self.high[place >> 3]) & ((1 << (place & 7)) - 1)).count("1")
        while (ones := bin(int(self.high[at])).count("1")) <= left:
            left -= ones
            at += 1
        byte = int(self.high[at])
        for bit in range(8):
            if byte >> bit & 1:
                if not left:
                    return (at * 8 + bit - i) << self.width | self._low(i)
                left -= 1
        raise ValueError("the directory does not fit the high bits")

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        low = np.zeros(self.n, np.int64)
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.width].reshape(self.n, self.width)
            low = (bits.astype(np.int64) << np.arange(self.width)).sum(1)
        return (places - np.arange(self.n)) << self.width | low


def encode_segment(ids: np.ndarray, boundaries: np.ndarray) -> bytes:
    width, high, low, directory = encode_boundaries(boundaries)
    header = struct.pack(_HEADER, _MAGIC, 1, ids.dtype.itemsize, width, len(boundaries) - 1, len(ids), len(high), len(low))
    return b"".join([header, directory.astype("<u8").tobytes(), high, low, ids.astype(ids.dtype.newbyteorder("<")).tobytes()])


class Segment:
    """Documents of an encoded segment by number."""

    def __init__(self, data):
        magic, version, size, width, docs, ids, high, low = struct.unpack_from(_HEADER, data, 0)
        if magic != _MAGIC or version != 1 or size not in (2, 4):
            raise ValueError("not a token segment")
        raw, at = np.frombuffer(data, np.uint8), struct.calcsize(_HEADER)
        marks = -(-(docs + 1) // _DIRECTORY_STEP)
        directory = raw[at:at + 8 * marks].view("<u8") if not at % 8 else np.frombuffer(raw[at:at + 8 * marks].tobytes(), "<u8")
        at += 8 * marks
        self.n = docs
        self.boundaries = Boundaries(docs + 1, width, raw[at:at + high], raw[at + high:at + high + low], directory)
        at += high + low
        self.ids = np.frombuffer(raw[at:at + size * ids].tobytes(), f"<u{size}")

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.boundaries[i]:self.boundaries[i + 1]]


# A worker process keeps the ids of words it has met, and forgets them when they are so many.
_MOST_WORDS = 1_000_000


class Encoder:
    """Ids of whole texts, exactly as the tokenizers library gives them, with words that recur encoded once.

    A byte-level tokenizer of this kind cuts a text before it merges, and never joins what a space or line break
    parts, but for one space that goes with the word after it. So a text without two white-space characters in a row
    is the chain of its words, each encoded with the space before it, and its line breaks. All other texts, and
    tokenizers that fail a trial of this, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings such as an end-of-text mark are ids of their own; texts with one are encoded whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, bytes] = {}
        self.line = self._whole(["\n"])[0]
        trial = "It's one,\nTwo three. x1 'y' été\n4 z's."
        self.by_word = len(self.line) == self.kind.itemsize and self._chains([trial])[0] == self._whole([trial])[0]

    @staticmethod
    def of(path: str) -> Encoder:
        return per_worker("encoder", path, lambda: Encoder(path))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> None:
        """Ids of many words at once: joined by line breaks, which never occur in a word, and cut at their id."""
        for at in range(0, len(keys), 4096):
            part = keys[at:at + 4096]
            whole = np.frombuffer(self._whole(["\n".join(k[1:] if k[0] == "\x01" else " " + k for k in part)])[0], self.kind)
            cuts = np.flatnonzero(whole == np.frombuffer(self.line, self.kind)[0])
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer does not keep line breaks apart")
            for key, a, b in zip(part, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(whole)]])):
                self.words[key] = whole[a:b].tobytes()

    def _chains(self, texts: list[str]) -> list[bytes]:
        keys = [("\x01" + t.replace("\n", " \n \x01")).split(" ") for t in texts]
        if len(self.words) > _MOST_WORDS:
            self.words.clear()
        self.words["\n"], self.words["\x01"] = self.line, b""
        new = set().union(*keys).difference(self.words)
        # a full stop or comma after a letter is cut off before merging, so it adds its own id to the word's
        ended = [k for k in new if k[-1] in ".," and k[-2:-1].isalpha()]
        own = new.difference(ended).union(k[:-1] for k in ended).union(("\x01.", "\x01,")).difference(self.words)
        if own:
            self._learn(list(own))
        for k in ended:
            self.words[k] = self.words[k[:-1]] + self.words["\x01" + k[-1]]
        get = self.words.__getitem__
        return [b"".join(map(get, k)) for k in keys]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``kind``; equal texts are encoded once."""
        found: dict[str, bytes] = {}
        plain, other = [], []
        for t in dict.fromkeys(texts):
            (plain if self.by_word and t and is_chain(t) and not any(s in t for s in self.special) else other).append(t)
        found.update(zip(plain, self._chains(plain)) if plain else ())
        found.update(zip(other, self._whole(other)) if other else ())
        return [found[t] for t in texts]


def is_chain(text: str) -> bool:
    """Whether only single spaces and line breaks part a text's words, and none stands at an end."""
    return " ".join(text.split()) == text.replace("\n", " ") and "\x01" not in text


def _text_groups(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[tuple[list, list[str]]]:
    ids, texts, at = batch.column("id").to_pylist(), batch.column("text").to_pylist(), 0
    while at < len(ids):
        to, held = at, 0
        while to < len(ids) and (to == at or held < size):
            held += len(texts[to] or "")
            to += 1
        yield ids[at:to], [t or "" for t in texts[at:to]]
        at = to


def write_tokens(df: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text", *, end_id: int = 0,
                 segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every text, add ``end_id`` and write segments in ascending id order to ``folder``; returns ``read_segments``.

    Rows are dealt to ordered ranges of (id, hash of text), so that a range is bounded and repeated ids may be spread;
    equal ids follow one another by that hash. A null or empty text is its end id alone, a null id comes first.
    A segment holds about ``segment_ids`` ids; a longer document is a segment of its own. An empty table writes no
    segment. Other columns are not looked at.
    """
    docs = only(df, id=id, text=text).withColumn("tie", F.xxhash64("text"))
    kind = dict(docs.dtypes)["id"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").withColumn("range", F.spark_partition_id())

    def run(batches):
        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        step = encoder.kind.itemsize
        names, pieces, total, number, range_id = [], [], 0, 0, 0

        def closed():
            sizes = np.array([len(p) // step for p in pieces], np.int64)
            data = encode_segment(np.frombuffer(b"".join(pieces), encoder.kind), np.concatenate([[0], np.cumsum(sizes)]))
            return pa.RecordBatch.from_arrays(
                [pa.array([range_id], pa.int32()), pa.array([number], pa.int64()), pa.array([total], pa.int64()), pa.array([names], pa.list_(arrow)), pa.array([data], pa.binary())],
                names=["range", "number", "n_ids", "ids", "segment"],
            )

        for batch in batches:
            arrow = batch.schema.field("id").type
            range_id = batch.column("range")[0].as_py() if batch.num_rows else range_id
            for ids, texts in _text_groups(batch):
                for name, piece in zip(ids, encoder.encode(texts)):
                    names.append(name)
                    pieces.append(piece + end)
                    total += len(piece) // step + 1
                    if total >= segment_ids:
                        yield closed()
                        names, pieces, total, number = [], [], 0, number + 1
        if names:
            yield closed()

    segments = ranges.mapInArrow(run, f"range int, number long, n_ids long, ids array<{kind}>, segment binary")
    segments.write.mode("errorifexists").parquet(folder)
    return read_segments(df.sparkSession, folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments as written, each with ``start``, the number of ids before it in the whole corpus.

    Starts are sums over ranges first (one row each), then over the segments inside a range.
    """
    from pyspark.sql import Window

    held = spark.read.parquet(folder)
    sizes = held.select("range", "number", "n_ids")
    by_range = sizes.groupBy("range").agg(F.sum("n_ids").alias("in_range")).select(
        "range", (F.sum("in_range").over(Window.orderBy("range")) - F.col("in_range")).alias("before")
    )
    inside = F.sum("n_ids").over(Window.partitionBy("range").orderBy("number")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(by_range, "range").select("range", "number", (F.col("before") + F.col("inside")).alias("start"))
    return held.join(starts, ["range", "number"])


def document_facts(segments: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the segments."""
    kind = dict(segments.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch.column("segment")[row].as_buffer())
                bounds = segment.boundaries.all()
                ids = segment.ids.astype("<u4")
                start = batch.column("start")[row].as_py()
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    found = segments.select("ids", "segment", "start").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id)
