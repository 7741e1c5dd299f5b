"""Spelling variants: words one edit apart, found among the sorted rotations of terminator-marked words (permuterm).

A word w is marked as w$ and turned by each of its places: the turn that ends in the character c at some place is y$xc, for
w = x c y. Words that differ in that character only share the prefix y$x and its length; the word without the character, x y,
has y$x as a whole turn of its own. So every turn stands in two groups: without its last character, as one of the words that
differ there, and whole, as the word that lacks a character there. A group has at most one word for each character and one
without, whatever the size of the corpus: groups are scanned in order, and each word leaves with the number of its neighbours
and the most frequent one. A character that repeats the one before it could be taken out at several places with one result;
only the first place counts, so that no pair of words meets twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.llm.storage import materialise, only

# U+00C0 to U+00FF are the bytes 0xC3 0x80 to 0xC3 0xBF of UTF-8, and 0xC3 begins nothing else.
_RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
MARK = "$"
_HELD_WORDS = 300_000
LONG_TURN = 64


def runs(df: DataFrame, id: str, text: str, slip: int | None) -> DataFrame:
    """(word, n): occurrences of lower-cased runs of letters over all texts, added up in each task before the shuffle."""
    docs = only(df, id=id, text=text)

    def counted(batches):
        held: Counter = Counter()

        def flushed():
            words = [w.decode() for w in held]
            found = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for own, t in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
                if not t:
                    continue
                found = _RUNS.findall(t.lower())
                if slip is None or own is None:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{own}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word, start)
                    if not h % slip:
                        points = word.decode()
                        at = h % len(points)
                        word = (points[:at] + points[at + 1:]).encode()
                    held[word] += n
            if len(held) > _HELD_WORDS:
                yield flushed()
        yield flushed()

    return docs.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _turns(words: DataFrame) -> DataFrame:
    """(turn, lacks, rank, n, first): every group a word stands in; ``lacks`` where it is the word without the character.

    Long turns are known by their digest, as a word of n characters has n of that length.
    """
    size = F.length("word")
    place = words.withColumn("at", F.explode(F.sequence(F.lit(0), size)))

    def turn(after, length):
        text = F.concat(after, F.lit(MARK), F.substring("word", F.lit(1), F.col("at")))
        return F.when(length > LONG_TURN, F.sha2(F.encode(text, "UTF-8"), 256)).otherwise(text)

    # the whole turn y$x with x = the first ``at`` characters, and the turn without the character that follows them
    own, last = F.substring("word", F.col("at") + 1, F.lit(1)), F.substring("word", F.col("at"), F.lit(1))
    whole = F.struct(turn(F.substring("word", F.col("at") + 1, size), size + 1).alias("turn"), F.lit(True).alias("lacks"), F.lit(False).alias("first"))
    without = F.struct(
        turn(F.substring("word", F.col("at") + 2, size), size).alias("turn"), F.lit(False).alias("lacks"), ((F.col("at") == 0) | (own != last)).alias("first")
    )
    both = F.when(F.col("at") < size, F.array(whole, without)).otherwise(F.array(whole))
    return place.select("rank", "n", F.explode(both).alias("t")).select("t.turn", "t.lacks", "rank", "n", "t.first")


def _best(members: list[tuple]) -> tuple | None:
    return min(members, key=lambda m: (-m[1], m[0]), default=None)


def _met(group: list[tuple]) -> list[tuple]:
    """(rank, n_near, near, near_n) of the members (rank, n, lacks, first) of a group that have neighbours in it."""
    out = []
    whole, others = [m for m in group if m[2]], [m for m in group if not m[2]]
    # the two best stand for "the best but oneself"
    best = _best(others)
    second = _best([m for m in others if m is not best])
    for m in others:
        lacking = whole if m[3] else []
        near = _best([x for x in (second if m is best else best, *lacking) if x])
        if near:
            out.append((m[0], len(others) - 1 + len(lacking), near[0], near[1]))
    longer = [m for m in others if m[3]]
    near = _best(longer)
    return out + ([(m[0], len(longer), near[0], near[1]) for m in whole] if near else [])


def _neighbours(words: DataFrame) -> DataFrame:
    """(rank, n_near, near, near_n) a group: of each word with neighbours there, their number and the most frequent of them."""

    def scanned(batches):
        turn, group = None, []

        def table(rows):
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rank", "n_near", "near", "near_n"])

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("turn", "rank", "n", "lacks", "first"))
            for own, *member in zip(*columns):
                if own != turn:
                    if len(group) > 1:
                        out.extend(_met(group))
                    turn, group = own, []
                group.append(member)
            yield table(out)
        yield table(_met(group) if len(group) > 1 else [])

    in_order = _turns(words).repartition("turn").sortWithinPartitions("turn")
    return in_order.mapInArrow(scanned, "rank long, n_near long, near long, near_n long")


def variants(df: DataFrame, id: str = "doc_id", text: str = "text", *, min_length: int = 6, min_count: int = 5, ratio: int = 5,
             slip: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``min_length`` code points with ``min_count`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Two are near if one inserted, deleted or replaced
    code point makes one the other. A word's form is its most frequent near word (ties: the smallest in code-point
    order) if that occurs at least ``ratio`` (2 or more) times as often, else null; its root is where forms lead, itself without one.
    With ``slip`` a character of every run whose checksum with its document's id is a multiple of it is deleted first; a
    null id's runs stay. Null and empty texts have no runs; rows of one id are counted each; an empty table gives no rows. Other
    columns are not looked at.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that forms lead to an end")
    words = runs(df, id, text, slip).where((F.length("word") >= min_length) & (F.col("n") >= min_count))
    # ranges of words in order, so that these numbers rise with the words; ties are settled by them
    words = materialise(words.repartitionByRange("word").sortWithinPartitions("word").withColumn("rank", F.monotonically_increasing_id()))
    near = _neighbours(words).groupBy("rank").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"),
    )
    formed = -F.col("best.less") >= ratio * F.col("n")
    found = materialise(words.join(near, "rank", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"),
        F.when(formed, -F.col("best.less")).alias("form_n"),
    ))
    # forms rise in frequency, so they end; each round doubles the length of the way that is known
    steps, moved = found.where("form IS NOT NULL").select("rank", F.col("form").alias("root")), True
    while moved:
        on = steps.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        longer = materialise(steps.join(on, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps, moved = longer.select("rank", "root"), bool(longer.where("moved").head(1))
    ways = found.where("form IS NOT NULL").select("rank", "form").join(steps, "rank")
    named = ways.join(words.select(F.col("rank").alias("form"), F.col("word").alias("form_word")), "form").join(
        words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root"
    ).select("rank", "form_word", "root_word")
    return found.join(named, "rank", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
