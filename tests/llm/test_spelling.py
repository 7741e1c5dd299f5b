"""Spelling variants against comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from columnscope.llm import spelling
from compare import connect, differences


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    name = "op13_spelling_variant_grouping"
    assert differences(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) is None


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, min_length, min_count, ratio, slip):
    counts: Counter = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{own}:{run}".encode())
            if slip and own is not None and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    form, others = {}, {}
    for w, n in words.items():
        others[w] = [v for v in words if near(w, v)]
        best = min(others[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(others[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("slip, long", [(None, 64), (7, 64), (7, 4)])
def test_all_pairs(spark, monkeypatch, slip, long):
    monkeypatch.setattr(spelling, "LONG_TURN", long)
    monkeypatch.setattr(spelling, "_HELD_WORDS", 40)
    rng = random.Random(3)
    stock = [w for w in ("".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(250)) if w]
    stock += ["aaaa", "aaaaa", "aaaaaa", "aabaa", "ab" * 60, "ab" * 60 + "a", "ab" * 30 + "c" + "ab" * 30, "ÀÀÀÀ", "ÿÿÿÿ×"]
    weights = [rng.choice([1, 1, 1, 8, 60, 500]) for _ in stock]
    rows = [(None if i == 3 else i % 50, " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in rng.choices(stock, weights, k=150)) + rng.choice(["", " 1x", "Āabab"]))
            for i in range(90)] + [(60, None), (61, ""), (62, "a1b")]
    got = spelling.variants(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, rank int, word string, n int").repartition(4),
                            min_length=2, min_count=3, ratio=2, slip=slip)
    want = plain(rows, 2, 3, 2, slip)
    assert rows_of(got) == want
    assert any(w != r and f != r for w, f, r, *_ in want), "chains of forms"


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert rows_of(spelling.variants(odd_documents, min_length=3, min_count=2, slip=5)) == plain(rows, 3, 2, 5, 5)
    assert spelling.variants(no_documents).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(odd_documents, ratio=1)
