"""Quality rules over documents, run as a cascade whose order follows from a sample.

Measures that every row's result needs are taken for all rows. Of the further rules each sees only the rows that all
rules before it passed. A bounded sample tells every rule's cost (seconds a document) and how much it rejects;
rules with the highest rejection per cost go first. The order changes the work, never which rows are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnscope.llm.storage import only
from columnscope.llm.words import Words, groups, mixed, seeded, shingles, sums_by, table

# The order of the rules is set on about so many documents, whatever the size of the table.
SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"


class Group:
    """A group of texts with what rules share, each part computed when first asked for."""

    def __init__(self, words: Words):
        self.words, self._held = words, {}

    def __len__(self) -> int:
        return len(self.words)

    def once(self, name: str, make: Callable) -> np.ndarray:
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def select(self, keep: np.ndarray) -> Group:
        """The group of the texts at these positions."""
        w = self.words
        at = np.flatnonzero(keep)
        part = object.__new__(Words)
        sizes = np.diff(w.offsets)[at]
        part.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        shift = part.offsets[:-1] - w.offsets[:-1][at]
        part.data = w.data[np.repeat(w.offsets[:-1][at] - part.offsets[:-1], sizes) + np.arange(sizes.sum())] if len(at) else w.data[:0]
        counts = w.counts()[at]
        part.bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        own = np.repeat(w.bounds[:-1][at] - part.bounds[:-1], counts) + np.arange(counts.sum())
        moved = np.repeat(shift, counts)
        part.starts, part.ends, part.hashes = w.starts[own] + moved, w.ends[own] + moved, w.hashes[own]
        return Group(part)

    def per_text(self, of_bytes: np.ndarray) -> np.ndarray:
        """Sum of a value of every byte, by text."""
        total = np.concatenate([[0], np.cumsum(of_bytes, dtype=np.int64)])
        return total[self.words.offsets[1:]] - total[self.words.offsets[:-1]]

    def per_word(self, of_words: np.ndarray) -> np.ndarray:
        """Sum of a value of every word, by text."""
        total = np.concatenate([[0], np.cumsum(of_words, dtype=np.int64)])
        return total[self.words.bounds[1:]] - total[self.words.bounds[:-1]]


def n_words(g: Group) -> np.ndarray:
    return g.words.counts()


def word_chars(g: Group) -> np.ndarray:
    """Code points in words: bytes that begin one, outside separators."""
    def make():
        w = g.words
        begins = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        return g.per_word(begins[w.ends] - begins[w.starts])

    return g.once("word_chars", make)


def n_symbols(g: Group) -> np.ndarray:
    return g.per_text(_lookup(SYMBOLS)[g.words.data])


def _lookup(of: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(of)] = True
    return found


def _lines(g: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start, end and text of every line with a word: texts are cut at \n."""
    def make():
        w = g.words
        breaks = np.flatnonzero(w.data == 10)
        text_starts = w.offsets[:-1]
        starts = np.concatenate([text_starts, breaks + 1])
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        text = np.concatenate([np.arange(len(w)), np.searchsorted(w.offsets, breaks, "right") - 1])[order]
        ends = np.minimum(np.concatenate([starts[1:] - 1, [len(w.data)]]), w.offsets[1:][text])
        last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool)
        ends = np.where(last, w.offsets[1:][text], ends)
        full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        return starts[full], ends[full], text[full]

    return g.once("lines", make)


def n_dup_lines(g: Group) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text, by their bytes."""
    starts, ends, text = _lines(g)
    h = _span_hashes(g, starts, ends)
    order = np.lexsort((h, text))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][again], minlength=len(g)).astype(np.int64)


def _span_hashes(g: Group, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, in the way words are hashed but with upper case kept apart."""
    def make():
        factor = np.uint64(0x9E3779B97F4A7C15)
        n = len(g.words.data)
        powers = np.full(n + 1, factor, np.uint64)
        powers[:1] = 1
        back = np.full(n + 1, pow(int(factor), -1, 1 << 64), np.uint64)
        back[:1] = 1
        with np.errstate(over="ignore"):
            powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
            values = seeded(256, 3)[g.words.data] * powers[:n]
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]), back

    sums, back = g.once("line_sums", make)
    with np.errstate(over="ignore"):
        return mixed((sums[ends] - sums[starts]) * back[starts]) ^ (ends - starts).astype(np.uint64)


def n_repeat_words(g: Group) -> np.ndarray:
    """Words covered by five-word windows that the text holds twice or more, the first of them included."""
    def make():
        w = g.words
        covered = np.zeros(len(w.hashes) + 1, np.int64)
        n = w.counts()
        h, bounds = shingles(w, 5)
        for i in np.flatnonzero(n > 5):
            own = h[bounds[i]:bounds[i + 1]]
            order = np.argsort(own, kind="stable")
            s = own[order]
            equal = s[1:] == s[:-1]
            if equal.any():
                twice = np.zeros(len(s), bool)
                twice[1:] |= equal
                twice[:-1] |= equal
                at = w.bounds[i] + order[twice]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + 5, -1)
        return g.per_word(np.cumsum(covered[:-1]) > 0)

    return g.once("repeat_words", make)


def base_failed(g: Group) -> np.ndarray:
    n = n_words(g)
    return (n < 10) | (100 * n_repeat_words(g) > 20 * n)


@dataclass(frozen=True)
class Rule:
    """``passes(group)`` is true for the texts that pass."""

    name: str
    passes: Callable[[Group], np.ndarray]


def _symbol_share(g: Group) -> np.ndarray:
    return 10 * n_symbols(g) <= n_words(g)


def _line_share(g: Group) -> np.ndarray:
    lines = np.bincount(_lines(g)[2], minlength=len(g))
    return 10 * n_dup_lines(g) <= 6 * np.maximum(lines, 1)


def _word_length(g: Group) -> np.ndarray:
    n = np.maximum(n_words(g), 1)
    return (word_chars(g) >= 2 * n) & (word_chars(g) <= 15 * n)


def _upper_share(g: Group) -> np.ndarray:
    upper = np.zeros(256, bool)
    upper[65:91] = True
    return 10 * g.per_text(upper[g.words.data]) <= 3 * np.maximum(word_chars(g), 1)


def _shout_share(g: Group) -> np.ndarray:
    """At most a tenth of the words end in an exclamation mark repeated."""
    w = g.words
    long = w.ends - w.starts > 2
    shout = np.zeros(len(w.ends), bool)
    shout[long] = (w.data[w.ends[long] - 1] == 33) & (w.data[w.ends[long] - 2] == 33)
    return 10 * g.per_word(shout) <= n_words(g)


def _letter_share(g: Group) -> np.ndarray:
    """At least half of the words hold a letter (ASCII, or any character beyond ASCII)."""
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    total = np.concatenate([[0], np.cumsum(letter[g.words.data])])
    return 10 * g.per_word(total[g.words.ends] > total[g.words.starts]) >= 5 * n_words(g)


def _word_repeats(g: Group) -> np.ndarray:
    """No word makes up more than 30 in 100 of a text of twenty words or more."""
    w = g.words
    text = np.repeat(np.arange(len(g)), w.counts())
    order = np.lexsort((w.hashes, text))
    h, t = w.hashes[order], text[order]
    if not len(h):
        return np.ones(len(g), bool)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
    most = np.zeros(len(g), np.int64)
    np.maximum.at(most, t[new], np.diff(np.concatenate([new, [len(h)]])))
    return (n_words(g) < 20) | (100 * most <= 30 * n_words(g))


RULES = (
    Rule("few_symbols", _symbol_share), Rule("few_repeated_lines", _line_share), Rule("word_length", _word_length),
    Rule("few_capitals", _upper_share), Rule("no_shouting", _shout_share), Rule("words_with_letters", _letter_share),
    Rule("no_word_dominates", _word_repeats),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejected: float


def estimates(df: DataFrame, text: str, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and share rejected of every rule on a sample of ``sample_rows``; the sample never grows with the input.

    Every row is drawn with the same chance; which rows are drawn decides the order of the rules only.
    """
    def run(batches):
        for _, words in groups(batches, lower=False):
            for rule in rules:
                group = Group(words)
                start = time.perf_counter()
                good = rule.passes(group)
                yield pa.RecordBatch.from_pydict({"name": [rule.name], "docs": [len(good)], "rejected": [int((~good).sum())], "seconds": [time.perf_counter() - start]})

    docs = only(df, text=text)
    rows = docs.sample(min(1.0, sample_rows / max(df.count(), 1)), seed=17).mapInArrow(run, "name string, docs long, rejected long, seconds double").groupBy("name").agg(
        F.sum("docs").alias("docs"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")
    ).collect()
    found = {r["name"]: r for r in rows}
    return [
        Estimate(r.name, found[r.name]["seconds"] / found[r.name]["docs"], found[r.name]["rejected"] / found[r.name]["docs"])
        if r.name in found else Estimate(r.name, 0.0, 0.0) for r in rules
    ]


def ordered(rules: tuple[Rule, ...], measured: list[Estimate]) -> list[Rule]:
    """Most rejection per cost first; equal ones as given."""
    worth = {e.name: e.rejected / max(e.cost, 1e-9) for e in measured}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(group: Group, rules: list[Rule], alive: np.ndarray) -> np.ndarray:
    """Position of the rule that rejects each text, -1 where none does; texts not ``alive`` meet no rule."""
    found = np.full(len(group), -1, np.int64)
    at = np.flatnonzero(alive)
    if len(at) < len(group):
        group = group.select(alive)
    for k, rule in enumerate(rules):
        if not len(at):
            break
        good = rule.passes(group)
        if not good.all():
            found[at[~good]] = k
            at = at[good]
            group = group.select(good)
    return found


def assess(df: DataFrame, id: str = "doc_id", text: str = "text", *, rules: tuple[Rule, ...] = RULES,
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures and verdict of every row: id, the counts, base_failed, kept and failed_rule.

    ``failed_rule`` names the rule that stopped the row (``base``, one of ``rules``, or null); where several would,
    it is the first in the estimated order, which may differ between runs. A null, empty or blank text has no
    words and fails the base. Nulls and repeats among ids are returned as they are, row for row; an empty table
    gives an empty result; other columns are not looked at.
    """
    order = ordered(rules, estimates(df, text, rules, sample_rows))
    names = np.array([r.name for r in order] + ["base", None], object)

    def run(batches):
        for batch, words in groups(batches, lower=False):
            group = Group(words)
            failed = base_failed(group)
            by = cascade(group, order, ~failed)
            yield table(
                id=batch.column("id"), n_words=n_words(group), word_chars=word_chars(group), n_symbols=n_symbols(group), n_dup_lines=n_dup_lines(group),
                n_repeat_words=n_repeat_words(group), base_failed=failed, kept=~failed & (by < 0),
                failed_rule=pa.array(names[np.where(failed, len(order), by)], pa.string()),
            )

    docs = only(df, id=id, text=text)
    schema = (
        f"id {dict(docs.dtypes)['id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, failed_rule string"
    )
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id)


def kept_rows(df: DataFrame, text: str = "text", *, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that pass, with all their columns."""
    order = ordered(rules, estimates(df, text, rules, sample_rows))
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part, words in groups(iter([named]), f"c{place}", lower=False):
                group = Group(words)
                failed = base_failed(group)
                good = ~failed & (cascade(group, order, ~failed) < 0)
                yield part.filter(pa.array(good)).rename_columns(batch.schema.names)

    return df.mapInArrow(run, df.schema)
