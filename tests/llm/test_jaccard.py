"""PartEnum joins against all pairs by brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from columnscope.llm import jaccard, storage


def brute(rows, width, threshold):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        full = {tuple(words[a:a + width]) for a in range(len(words) - width + 1)}
        sets[i] = full or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders.get(s, ()))
        for j, n in common.items():
            if n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def near_copies(seed=5, n=700):
    rng = random.Random(seed)
    sizes = [1, 2, 3, 4, 5, 6, 8, 10, 14, 20, 40, 80, 150]
    bases = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60)) for _ in range(rng.choice(sizes))] for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            p = rng.randrange(len(words) + 1)
            kind = rng.random()
            if kind < 0.4:
                words[p % len(words)] = f"zz{rng.randint(0, 9)}"
            elif kind < 0.7:
                words.insert(p, f"yy{rng.randint(0, 9)}")
            elif len(words) > 1:
                del words[p % len(words)]
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "One two"), (n + 4, "one TWO")]


@pytest.mark.parametrize("width,threshold", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(7, 10))])
@pytest.mark.parametrize("listed", [24, 2])
def test_against_all_pairs(spark, monkeypatch, width, threshold, listed):
    """Short buckets are listed, long ones compared in blocks; both ways give every link."""
    monkeypatch.setattr(jaccard, "LISTED_MEMBERS", listed)
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 7)
    rows = near_copies()
    found = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), width=width, threshold=threshold)
    assert sorted(map(tuple, found.collect())) == brute(rows, width, threshold)


def test_odd_rows(odd_documents, no_documents):
    rows = sorted(map(tuple, jaccard.similar(odd_documents, width=3).collect()), key=str)
    by_id = {r[0]: r for r in rows}
    assert len(rows) == 10 and sum(r[0] == 5 for r in rows) == 2
    assert by_id[5][2] == 1 and by_id[None][2] is None and by_id[None][1] == 10
    assert by_id[2] == (2, 0, 2) and by_id[8][2] == 7 and by_id[9] == (9, 1, 9)
    assert jaccard.similar(no_documents).count() == 0
    kept = jaccard.one_of_each(odd_documents, width=3)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 9]


def test_query(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = entry.queries()["op6_ngram_jaccard_join"](spark, folder)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3, Fraction(9, 10))


def test_signatures_with_the_same_members_are_kept_once(spark):
    members = {1: "abc", 2: "abc", 3: "abd", 4: "ab", 5: "ab", 6: "e", 7: "cd"}
    rows = spark.createDataFrame([(sig, id) for sig, ids in members.items() for id in ids] + [(5, "b")], "sig long, id string").repartition("sig")
    found = {}
    for r in jaccard._buckets(rows).collect():
        found.setdefault((r.sig, r.first), []).append(r.id)
    # rows that repeat make a bucket look different, which loses nothing
    assert {(*k, "".join(sorted(v))) for k, v in found.items()} == {(1, "a", "abc"), (3, "a", "abd"), (4, "a", "ab"), (5, "a", "ab"), (7, "c", "cd")}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_copies_stand_for_their_representative(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", most)
    base = [f"w{i}" for i in range(60)]
    texts = [base, base, base[:59] + ["x"], base[:59] + ["x"], ["y"] + base[1:59] + ["x"], [f"v{i}" for i in range(40)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1, " ".join(base)), (3, "only once"), (None, " ".join(base))]
    found = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=3, threshold=Fraction(9, 10))
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, None: None}


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(1)
    apart = 0
    for _ in range(3000):
        n, changes = int(rng.integers(1, 600)), int(rng.integers(0, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[:max(0, n - changes)], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + changes)), dtype=np.uint64)]))
        near = jaccard.may_be_alike(jaccard.sketch(x), jaccard.sketch(y), len(x), len(y), Fraction(4, 5))
        assert near or not jaccard._alike(x, y, Fraction(4, 5))
        apart += not near
    assert apart > 1000


def test_whole_sets_travel_only_where_sketches_are_near(spark, monkeypatch):
    base = [f"w{i}" for i in range(300)]
    texts = [base, base[:299] + ["x"], base[:150] + [f"v{i}" for i in range(150)], base[:100] + [f"u{i}" for i in range(200)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    pairs = spark.createDataFrame([(a, b) for b in range(4) for a in range(b)], "a long, b long")
    sketches = jaccard._some_sets(docs, 5, docs.select("id"), sketches=True)
    asked, some_sets = [], jaccard._some_sets
    monkeypatch.setattr(jaccard, "_some_sets", lambda docs, width, ids: asked.extend(sorted({r.id for r in ids.collect()})) or some_sets(docs, width, ids))
    assert [tuple(r) for r in jaccard._verified(pairs, sketches, docs, 5, Fraction(4, 5)).collect()] == [(0, 1)]
    assert asked == [0, 1]


def test_workers_of_the_join_drop_what_other_operators_keep():
    first = storage.per_worker("kind", "key", list)
    assert storage.per_worker("kind", "key", list) is first
    assert list(storage.lean(iter([1, 2]))) == [1, 2]
    assert storage.per_worker("kind", "key", list) is not first


def test_texts_come_to_the_join_in_batches_of_bounded_size(spark, monkeypatch):
    """A batch of 10,000 rows, Spark's bound, would have all 20 MB of these texts."""
    groups = jaccard.groups

    def bounded(batches):
        def held():
            for batch in batches:
                # one row more, and the arrays beside the texts
                assert batch.nbytes < storage.BATCH_BYTES + 100_000
                yield batch

        return groups(held())

    monkeypatch.setattr(jaccard, "groups", bounded)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1100))) for i in range(2000)] + [(5000, " ".join(f"w7x{j}" for j in range(1099)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in jaccard.similar(docs).collect()}
    assert found == {i: i for i, _ in rows[:-1]} | {5000: 7}
    assert spark.conf.get(storage._BATCH_CONF, None) is None


def test_a_bound_that_the_session_sets_stays(spark):
    spark.conf.set(storage._BATCH_CONF, "1000000")
    try:
        with storage.small_batches(spark):
            assert spark.conf.get(storage._BATCH_CONF) == "1000000"
        assert spark.conf.get(storage._BATCH_CONF) == "1000000"
    finally:
        spark.conf.unset(storage._BATCH_CONF)
