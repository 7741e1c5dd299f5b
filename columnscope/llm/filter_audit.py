"""How document filters act on one another: what each removes in every order they could be applied in.

Each document gets a mask of the filters it fails; a report over all orders then needs counts by mask only. One of
the filters is "an equal text has a smaller id", for which whole texts are put into compressed (radix) tries:

* every task inserts its texts into a trie whose terminals hold the smallest id met so far. A row that comes after a
  smaller id of its text is a repeat already and travels on without its text, so that a text held by very many rows
  is shuffled once a batch at most;
* the other texts go to the range of texts they belong to. Ranges are cut at prefixes just long enough to part
  neighbours of a sorted sample, so texts that begin alike are still parted. The sample only balances the ranges;
* a task reads the texts of a range in order, inserts them into a trie, and traverses it: rows above their terminal's
  smallest id are repeats. Texts come sorted, so a trie that has grown to its limit is traversed and a new one begun.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.functions.sizing import estimated_bytes
from columnscope.llm.storage import only

# In the order of their bits: few words, little variety, many capitals, symbols, repeats a text of smaller id.
FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")

RANGE_BYTES = 32 << 20
MAX_RANGES = 16_384
SAMPLE_PER_RANGE = 32
OFFER = 8
TRIE_BYTES = 48 << 20
_NODE_BYTES = 300

_CAPITALS = bytes(range(65, 91))
_CONTINUATIONS = bytes(range(128, 192))
_SYMBOLS = b"#$%&*|"


def failed_measures(text: bytes) -> int:
    """Mask of the filters A to D that a UTF-8 text fails. Bytes are split at U+0020 and U+0009 to U+000D."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUATIONS))
    return (
        (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2
        | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3
    )


class Trie:
    """A compressed trie of byte strings. A node is [label, children by first byte, smallest id, rows]; one with rows is a terminal."""

    def __init__(self):
        self.root = [b"", {}, None, None]
        self.bytes = 0

    def insert(self, text: bytes) -> list:
        """The terminal of ``text``; labels are split where texts part."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None, None]
                self.bytes += end - at + _NODE_BYTES
                node[1][text[at]] = child
                node = child
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = common(label, text, at)
            upper = [label[:same], {label[same]: child}, None, None]
            child[0] = label[same:]
            node[1][text[at]] = upper
            self.bytes += _NODE_BYTES
            node, at = upper, at + same
        if node[3] is None:
            node[3] = []
        return node

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            stack.extend(node[1].values())
            if node[3] is not None:
                yield node


def common(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``label`` stand at ``at`` in ``text``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _bytes_of(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def prefix_cuts(docs: DataFrame, ranges: int) -> list[bytes]:
    """Prefixes that cut the texts into ranges of about equal size.

    Sample texts are sorted, and each offers the prefix that is just longer than what it shares with the text before; offers
    are thinned by the bytes they stand for. A prefix is no longer than 4 KiB, as it serves balance alone.
    """
    rows = docs.count()
    if ranges <= 1 or not rows:
        return []
    keep = max(1, rows // (ranges * SAMPLE_PER_RANGE))
    sample = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(keep)) == 0).distinct()

    def cut(batches):
        last, held = None, 0
        for batch in batches:
            found, sizes = [], []
            for n, text in enumerate(_bytes_of(batch)):
                held += len(text)
                # the first text of a task has no neighbour, every eighth of the others is enough
                if last is None or n % OFFER == 0:
                    found.append(text[:min(64 if last is None else common(text, last, 0) + 1, 4096)])
                    sizes.append(held)
                    held = 0
                last = text
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], names=["cut", "size"])

    in_order = sample.repartitionByRange(max(1, ranges // 8), F.substring("text", 1, 64)).sortWithinPartitions("text")
    # a few prefixes for each range come to the driver
    offers = sorted((bytes(r["cut"]), r["size"]) for r in in_order.mapInArrow(cut, "cut binary, size long").collect())
    each, passed, cuts = sum(n for _, n in offers) / ranges, 0, []
    for prefix, size in offers:
        passed += size
        if passed >= each and prefix and prefix != (cuts[-1] if cuts else None):
            cuts.append(prefix)
            passed = 0
    return cuts


def masks(df: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of every row: the filters it fails, as bits in the order of ``FILTERS``.

    A null text is empty, a null part the empty string. A null id is smaller than no id and no id is smaller than it.
    Rows of one id and text are no repeats of each other. Other columns are not looked at.
    """
    docs = only(df, id=id, text=text, part=part)
    kind = dict(docs.dtypes)["id"]
    size = estimated_bytes(df)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    ranges = MAX_RANGES if size is None else min(MAX_RANGES, max(cores, -(-size // RANGE_BYTES)))
    cuts = docs.sparkSession.sparkContext.broadcast(prefix_cuts(docs, ranges))

    def measured(batches):
        # a worker process takes several tasks: texts it has met in earlier ones play no part
        trie, turn, count = Trie(), 0, len(cuts.value) + 1
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), _bytes_of(batch)
            found = np.zeros(batch.num_rows, np.int32)
            place = np.zeros(batch.num_rows, np.int32)
            known = np.zeros(batch.num_rows, bool)
            for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i])):
                t = texts[i] or b""
                mask = failed_measures(t)
                node = trie.insert(t)
                if ids[i] is None or (node[2] is not None and ids[i] > node[2]):
                    mask |= REPEAT if ids[i] is not None else 0
                    known[i] = True
                    turn += 1
                    place[i] = turn % count
                else:
                    node[2] = ids[i]
                    place[i] = bisect.bisect_right(cuts.value, t)
                found[i] = mask
            if trie.bytes > TRIE_BYTES:
                trie = Trie()
            kept = batch.column("text")
            kept = kept.fill_null("") if kept.null_count else kept
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(found), pa.array(place), pc.if_else(pa.array(known), pa.scalar(None, kept.type), kept)],
                names=["id", "part", "mask", "place", "text"],
            )

    def repeats(batches):
        trie, held, previous = Trie(), [], None

        def closed():
            if not held:
                return
            found = [batch.column("mask").to_numpy(zero_copy_only=False).copy() for batch in held]
            for node in trie.terminals():
                for b, i, own in node[3]:
                    if own > node[2]:
                        found[b][i] |= REPEAT
            for batch, mask in zip(held, found):
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(mask)], names=["id", "part", "mask"])

        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), _bytes_of(batch)
            # a copy, as columns of a batch that was sent keep all of it in memory
            light = batch.select(["id", "part", "mask"]).take(pa.array(np.arange(batch.num_rows)))
            start = 0
            held.append(light)
            for i, t in enumerate(texts):
                if t is None:
                    continue
                if trie.bytes > TRIE_BYTES and t != previous:
                    held[-1] = light.slice(start, i - start)
                    yield from closed()
                    trie, held, start = Trie(), [light.slice(i)], i
                node = trie.insert(t)
                if node[2] is None or ids[i] < node[2]:
                    node[2] = ids[i]
                node[3].append((len(held) - 1, i - start, ids[i]))
                previous = t
            held[-1] = light.slice(start)
        yield from closed()

    sent = docs.mapInArrow(measured, f"id {kind}, part string, mask int, place int, text string")
    ordered = sent.repartitionById(len(cuts.value) + 1, F.col("place")).sortWithinPartitions("text")
    found = ordered.mapInArrow(repeats, f"id {kind}, part string, mask int")
    return found.withColumn("part", F.coalesce("part", F.lit("")))


def _steps() -> list[tuple]:
    """(order, step, letter's bit, bits of the letters before it) of all orders."""
    bit = {letter: 1 << i for i, letter in enumerate(FILTERS)}
    return [
        ("".join(order), step + 1, bit[letter], sum(bit[b] for b in order[:step]))
        for order in itertools.permutations(FILTERS) for step, letter in enumerate(order)
    ]


def report(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What every filter removes in every order, for each part: one row per (part, filter_order, step).

    kept: left after the step; removed: removed by it; redundant: failing its filter, but removed before; unique_fails:
    failing its filter only; good_lost, toxic_lost: removed rows whose id has a label quality = 1, toxic = 1; shapley: removed
    by its filter summed over all orders. ``labels`` may lack ids, hold null ones, or hold several rows of one id (any of
    them counts). An empty table has no parts, so no rows.
    """
    counted = masks(df, id, text, part).groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("rows"))
    marked = only(labels, id=id, quality="quality", toxic="toxic").where("id is not null").groupBy("id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    rows = F.col("rows")
    by_mask = counted.join(marked, "id", "left").groupBy("part", "mask").agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum(rows * F.col("good")), F.lit(0)).alias("good"), F.coalesce(F.sum(rows * F.col("toxic")), F.lit(0)).alias("toxic"),
    )
    orders = _steps()
    # a step's counts depend on its filter and the set of those before it alone: 5 x 16 pairs
    pairs = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in sorted({s[2:] for s in orders})])
    mask, bit, before = F.col("mask"), F.col("at.bit"), F.col("at.before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(column, condition):
        return F.sum(F.when(condition, column).otherwise(F.lit(0)))

    # of the orders of all filters, a row that fails k of them meets each of the k first in 1 / k
    share = (F.lit(len(orders) // len(FILTERS)) / F.greatest(F.bit_count(mask), F.lit(1))).cast("long")
    counts = by_mask.withColumn("at", F.explode(pairs)).groupBy("part", bit.alias("bit"), before.alias("before")).agg(
        total(rows, ~fails & ~earlier).alias("kept"), total(rows, fails & ~earlier).alias("removed"), total(rows, fails & earlier).alias("redundant"),
        total(rows, mask == bit).alias("unique_fails"), total(F.col("good"), fails & ~earlier).alias("good_lost"),
        total(F.col("toxic"), fails & ~earlier).alias("toxic_lost"), total(rows * share, fails).alias("shapley"),
    )
    steps = df.sparkSession.createDataFrame(orders, "filter_order string, step int, bit int, before int")
    return counts.join(F.broadcast(steps), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
