"""Packing against the library's ids, the lower bound of sequences, and plain best fit; plans on tables of lengths."""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from columnscope.llm import packing
from columnscope.llm.word_ids import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["<|endoftext|> a b", "a<|startoftext|>b", "it's 'sun ,'s 'RE'll", "ÀÉ ß Straße ﬁ ǅ İstanbul ΣΑΣ", "é x y　z a\u0085b", "\x1cq r\x1f", "१२ 12½ª", "a​b", "x" * 500, "é" * 300,
         "\x00 a", "á b", " ̸= c", "<<|< >", "", "\t\n", "東京 tower"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text(max_size=20), st.text(st.sampled_from("abÉ'sl1,<| \n"), max_size=40)), max_size=8))
def test_words_encode_as_whole_texts(texts):
    found = WordEncoder.of(PATH).encode([t.encode() for t in texts])
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def best_fit_decreasing(lengths, capacity):
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 6))
def test_plans(lengths, groups):
    capacity = 60
    counts = Counter(lengths)
    plan = packing.LargePlan({n: c for n, c in counts.items() if n > 10}, capacity, groups)
    rooms = [capacity] * plan.sequences
    for n in (n for n in counts if n > 10):
        for s in plan(plan.before[n] + np.arange(counts[n])).tolist():
            rooms[s] -= n
    assert min(rooms, default=0) >= 0
    moves, new = packing.fill(dict(Counter(r for r in rooms if r)), {n: c for n, c in counts.items() if n <= 10}, capacity)
    by_gap = defaultdict(list, {0: [capacity] * new})
    for r in rooms:
        by_gap[r].append(r)
    by_gap[0] = [capacity] * new
    placed: Counter = Counter()
    for n, rank, gap, first, times in moves:
        for k in range(times):
            by_gap[gap][first + k] -= n
            placed[n, rank + k] += 1
    assert all(r >= 0 for own in by_gap.values() for r in own)
    assert placed == Counter((n, k) for n in counts if n <= 10 for k in range(counts[n]))


def test_configurations_are_optimal():
    # three sizes that fill a sequence exactly in one way: 6 + 3 + 1
    found = packing.configurations(np.array([1, 3, 6]), np.array([1000, 1000, 1000]), 10)
    assert sum(times for _, times in found) == 1000
    assert sum(config * times for config, times in found).tolist() == [1000, 1000, 1000]


def checked(rows, docs, capacity):
    """Every piece as it must be, sequences without gaps and within capacity; the number of sequences."""
    want = Counter()
    for own, text in docs:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), capacity):
            part = ids[start:start + capacity]
            want[own, start // capacity, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = entry.queries()["op12_best_fit_packing"](spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    n = checked(rows, docs, 2048)
    lengths = [r.length for r in rows]
    assert -(-sum(lengths) // 2048) <= n <= 1.02 * best_fit_decreasing(lengths, 2048) + 1


@pytest.mark.parametrize("rank_rows", [7, 100_000])
def test_many_of_one_length(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    rng = random.Random(6)
    docs = [(i % 900, "one two three" if i % 3 == 0 else None if i % 50 == 1 else " ".join(["word"] * rng.randint(0, 90))) for i in range(1000)]
    rows = packing.pack(spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, length int, sequence_id int, bucket string").repartition(6), PATH,
                        capacity=64, groups=5).collect()
    assert checked(rows, docs, 64) <= 1.05 * -(-sum(r.length for r in rows) // 64) + 1


def test_odd_rows(odd_documents, no_documents):
    rows = packing.pack(odd_documents, PATH, capacity=100).collect()
    checked(rows, [(r.doc_id, r.text) for r in odd_documents.collect()], 100)
    assert packing.pack(no_documents, PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(odd_documents, PATH, capacity=1)
