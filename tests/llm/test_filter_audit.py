"""Filter audits against plain counting over all orders, and the tries they rest on."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from columnscope.llm import filter_audit
from compare import connect, differences


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    name = "op11_filter_interaction_audit"
    assert differences(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b))), max_size=30))
def test_trie(rows):
    trie, least = filter_audit.Trie(), {}
    for i, (own, text) in enumerate(rows):
        node = trie.insert(text)
        node[2] = own if node[2] is None else min(node[2], own)
        node[3].append(i)
        least[text] = min(least.get(text, own), own)
    found = {i: node[2] for node in trie.terminals() for i in node[3]}
    assert found == {i: least[text] for i, (_, text) in enumerate(rows)}
    assert sum(1 for _ in trie.terminals()) == len(least)


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)))


def plain_report(rows, labels):
    least: dict = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    marks: dict = {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    docs = [(part or "", (*failed(text or ""), i is not None and i > least[text or ""]), marks.get(i, (False, False)) if i is not None else (False, False))
            for i, text, part in rows]
    out: dict = {}
    for part in {p for p, _, _ in docs}:
        own = [d for d in docs if d[0] == part]
        shapley: Counter = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                at = "ABCDE".index(letter)
                gone, stay = [d for d in left if d[1][at]], [d for d in left if not d[1][at]]
                fails = [d for d in own if d[1][at]]
                out[part, "".join(order), step] = [len(stay), len(gone), len(fails) - len(gone), sum(sum(d[1]) == 1 for d in fails),
                                                   sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)]
                shapley[letter] += len(gone)
                left = stay
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[letter])
    return out


def rows_of(df):
    return {tuple(r)[:3]: list(tuple(r)[3:]) for r in df.collect()}


@pytest.mark.parametrize("tiny", [False, True])
def test_against_counting(spark, monkeypatch, tiny):
    if tiny:
        monkeypatch.setattr(filter_audit, "RANGE_BYTES", 2000)
        monkeypatch.setattr(filter_audit, "SAMPLE_PER_RANGE", 2)
        monkeypatch.setattr(filter_audit, "TRIE_BYTES", 3000)
    rng = random.Random(4)
    stock = ["", "A b #", "x " * 300, *(f"shared beginning of many texts {'y' * rng.randint(0, 40)} {rng.randint(0, 60)}" for _ in range(80)), "Été 東京 " * 90]
    stock += [" ".join(f"w{rng.randint(0, 900)}" for _ in range(250)) for _ in range(10)]
    rows = [(rng.choice([None, i, i, i, i, i % 40]), rng.choice([*stock, None, *stock[1:2] * 60]), rng.choice(["s", "t", "", None])) for i in range(700)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 700, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = filter_audit.report(
        spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, mask int, quality string").repartition(5),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
    assert rows_of(got) == plain_report(rows, labels)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(5, 1, None)], "doc_id long, quality int, toxic int")
    want = plain_report([(r.doc_id, r.text, r.source) for r in odd_documents.collect()], [(5, 1, None)])
    assert rows_of(filter_audit.report(odd_documents, labels)) == want
    assert filter_audit.report(no_documents, labels).count() == 0
    assert rows_of(filter_audit.report(odd_documents.where("doc_id = 3"), labels.limit(0)))["src1", "EDCBA", 5] == [0, 1, 0, 1, 0, 0, 120]
