"""Scores on held-out rows, and the searches against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from columnscope.llm import decontamination, quality_classifier, repeats, toxicity

FOLDER = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize("name,label,least", [("op8_quality_classifier", "quality", 0.95), ("op4_toxicity", "toxic", 0.6)])
def test_held_out(spark, name, label, least):
    rows = entry.queries()[name](spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert len(rows) == docs and rows["score"].between(0, 1).all()
    held = rows[rows["held_out"]].merge(spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas(), on="doc_id")
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) >= least


def talk(rng, rude, n):
    words = "the house river walks slowly green morning over paper table and of with near small".split()
    return " ".join(rng.choice(["grobxian", "grobxiol", "vlatgrob"]) if rude and rng.random() < 0.06 else rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(n))


def test_toxicity_learns_parts_of_words(spark):
    rng = random.Random(1)
    rows = [(i, talk(rng, i % 5 == 0, rng.randint(20, 80)), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-1, None), (-2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(-1, None), (None, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    held = [(found[i], y) for i, _, y in rows if i >= 400]
    assert auc(np.array([s for s, _ in held]), np.array([y for _, y in held])) > 0.95
    assert found[-1] == found[-2] and 0 < found[-1] < 1


@pytest.mark.parametrize("score", [toxicity.score, quality_classifier.score])
def test_odd_rows(spark, score, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (7, 0), (5, 1), (9, 0), (3, 7)], "doc_id long, mark int")
    found = score(odd_documents, labels, label="mark")
    assert found.columns == ["doc_id", "score"] and found.where("score between 0 and 1").count() == 10
    assert score(odd_documents, labels.limit(0), label="mark").count() == 10
    assert score(no_documents, labels, label="mark").count() == 0


def test_network_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, quality_classifier.FEATURES))
    y = (x[:, 0] + 0.7 * np.abs(x[:, 1]) > 0.5).astype(float)
    net = quality_classifier.fit_network(x[:2000], y[:2000])
    assert ((net.logits(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.8
    honest = rng.normal(size=4000) * 2
    labels = (rng.random(4000) < 1 / (1 + np.exp(-honest))).astype(float)
    assert abs(quality_classifier.fitted_temperature(3 * honest, labels) - 3) < 0.4


def norm(text):
    return " " + " ".join(re.findall(r"[0-9a-zA-Z\u0080-\U0010ffff]+", (text or "").lower())) + " "


def test_every_copied_item_is_found(spark):
    found = {(r.doc_id, r.item_id) for r in entry.queries()["op5_benchmark_decontamination"](spark, FOLDER).collect()}
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() for i, t in items.items() if t in norm(r.text)}
    assert len(want & found) >= 0.97 * len(want) and len(found - want) <= 0.05 * len(want) + 1


def test_paraphrases(spark, odd_documents, no_documents):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "kalmnoprstuvz" for b in ["era", "ino", "ust", "ome", "ick", "and"]]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 45)))) for i in range(40)]

    def changed(text):
        words = text.split()
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words) * 3 // 4)] = "other"
        return " ".join(words)

    other = [f"{a}{b}" for a in "bcdfghjqwxy" for b in ["alo", "etu", "igo", "oss"]]
    docs = []
    for i in range(200):
        words = [rng.choice(other) for _ in range(rng.randint(30, 300))]
        if i < 40:
            words[10:10] = changed(items[i][1]).split()
        docs.append((i, " ".join(words)))
    benchmark = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert len(found & {(i, i) for i in range(40)}) >= 38 and all(a == b for a, b in found)
    assert decontamination.leaks(odd_documents, benchmark).count() == 0 and decontamination.leaks(no_documents, benchmark).count() == 0
    assert decontamination.clean_rows(odd_documents, benchmark.limit(0)).count() == 10
    own = spark.createDataFrame([(1, "ONE two, three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    kept = decontamination.clean_rows(odd_documents, own)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7, 8, 9]


def test_items_without_their_rarest_words(spark):
    rng = random.Random(3)
    often, rare = [f"often{i}" for i in range(60)], [f"rare{i}" for i in range(4000)]
    items, docs = [], []
    for i in range(30):
        size = rng.randint(20, 55)
        words = [rng.choice(often) for _ in range(size)]
        places = rng.sample(range(size), size * 3 // 10)
        for p in places:
            words[p] = rng.choice(rare)
        items.append((i, " ".join(words)))
        # 25 to 30 % of the words are other ones, so the rest is a subsequence of at least 0.7
        for p in places[:int(size * (0.25 if i % 2 else 0.3))]:
            words[p] = f"new{rng.randrange(4000)}"
        own = [f"own{rng.randrange(3000)}" for _ in range(100)]
        docs.append((i, " ".join(own[:40] + words + own[40:])))
    docs += [(100 + i, " ".join(rng.choice(often + rare[:400]) for _ in range(80))) for i in range(300)]
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(i, i) for i in range(30)} <= {(r.doc_id, r.item_id) for r in found}
    assert all(r.common >= 0.5 for r in found)


def test_items_that_share_too_few_words_are_passed_over():
    rng = random.Random(12)
    often, rare = [f"often{i}" for i in range(30)], [f"rare{i}" for i in range(400)]

    def text(n):
        return [rng.choice(often) if rng.random() < 0.2 else rng.choice(rare) for _ in range(n)]

    items = [text(n) for n in (3, 7, 8, 9, 20, 38, 59, 90)]
    texts = [text(rng.randint(0, 400)) for _ in range(30)]
    for i, own in enumerate(items):
        at = rng.randrange(200)
        texts.append(text(200))
        texts[-1][at:at] = [w if j % 5 else "other" for j, w in enumerate(own)] if len(own) >= 8 else own
    tables = decontamination._tables()
    words = decontamination.Words(*decontamination.text_bytes(pa.array([" ".join(t) for t in texts])), tables)
    held = [(i, decontamination.Words(*decontamination.text_bytes(pa.array([" ".join(own)])), tables).hashes.tolist(), [0]) for i, own in enumerate(items)]
    known = np.unique(decontamination.terms(np.array([h for _, own, _ in held for h in own], np.uint64)))
    rows = np.full(decontamination.TERMS, len(known), np.int32)
    rows[known] = np.arange(len(known))
    index = decontamination.Index(np.ones(decontamination.TERMS, np.float32), rows, np.zeros((len(known) + 1, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.int64), held)
    possible = decontamination._possible(words, index, rows[decontamination.terms(words.hashes)])
    for size in decontamination.WINDOWS:
        for t, a, b in zip(*decontamination._windows(words, size)):
            for i, own, _ in held:
                reach, least = (2, 0.9) if len(own) < 8 else (1, 0.5)
                region = words.hashes[max(words.bounds[t], a - reach * len(own)):min(words.bounds[t + 1], b + reach * len(own))].tolist()
                assert possible[t, i] or index.common(i, region) / len(own) < least
    assert all(possible[30 + i, i] for i in range(len(items))) and possible[:, 4:7].mean() < 0.5


def test_chain_by_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        points = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(1, 14))}, key=lambda p: (p[0], -p[1]))
        chain = repeats.best_chain([p[0] for p in points], [p[1] for p in points])

        def value(c):
            return sum(repeats.RUN - (repeats.GAP_COST * (points[b][0] - points[a][0] + points[b][1] - points[a][1]) if a is not None else 0) for a, b in zip([None, *c[:-1]], c))

        best = max(value(c) for c in subsets(points))
        assert abs(value(chain) - best) < 1e-9


def subsets(points):
    found = [[i] for i in range(len(points))]
    for c in found:
        yield c
        for j in range(c[-1] + 1, len(points)):
            if points[j][0] > points[c[-1]][0] and points[j][1] > points[c[-1]][1]:
                found.append([*c, j])


def test_passages(spark, odd_documents, no_documents):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(70)]
    docs, holders = [], set()
    for i in range(120):
        own = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        if i % 6 == 0:
            copy = list(passage)
            for _ in range(i % 4):
                copy[rng.randrange(70)] = "changed"
            own[20:20] = copy
            holders.add(i)
        docs.append((i, " ".join(own)))
    docs += [(500, docs[3][1]), (501, docs[3][1].upper()), (502, None)]
    rows = repeats.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id for r in rows} | {r.other_doc_id for r in rows}
    assert got == holders | {3, 500, 501}
    assert {r.class_id for r in rows if r.doc_id in holders} == {0} and {r.class_id for r in rows if r.doc_id >= 500} == {3}
    assert all(r.end_word - r.first_word >= 50 and r.identity >= 0.8 for r in rows)
    found = repeats.passages(odd_documents).collect()
    assert {(r.doc_id, r.other_doc_id) for r in found} <= {(7, 8), (8, 7)} and found
    assert repeats.passages(no_documents).count() == 0


def test_seeds_of_runs_fill_their_bit_map_evenly():
    tables = repeats.Tables()
    words = repeats.Words(*decontamination.text_bytes(pa.array([" ".join(f"w{i * 7919 % 100_003}" for i in range(50_000))])), tables)
    seeds = np.unique(repeats._whole_runs(words, repeats.MIN_WORDS, tables)[3])
    eighths = np.bincount((seeds >> np.uint64(61)).astype(np.int64), minlength=8) / len(seeds)
    assert len(seeds) > 2000 and eighths.min() > 0.08 and eighths.max() < 0.18


def test_equal_passages_by_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    line = [rng.choice(words) for _ in range(9)]
    shared = [rng.choice(words) for _ in range(56)]
    # parts of the shared passage stand in documents of lower and of higher ids, so its seeds have other first and last ones
    parts = [shared[i:i + 22] for i in range(0, 35, 2)]
    docs = []
    for i in range(90):
        own = [rng.choice(words) for _ in range(rng.randint(80, 160))]
        if i in (5, 44):
            # places whose lowest byte is not a character by itself
            own[:0] = [f"early{i} {j}" for j in range(470 if i == 5 else 60_000)]
        own[-30:-30] = ["same"] * 70 if i in (5, 40, 41) else line * 8 if i in (7, 50) else shared if i in (44, 47) else parts[i % len(parts)] if i < 30 or i >= 60 else []
        docs.append((i, " ".join(own)))
    holders: dict[tuple, set] = {}
    for i, text in docs:
        own = text.split()
        for a in range(len(own) - 49):
            holders.setdefault(tuple(own[a:a + 50]), set()).add(i)
    want = {i for ids in holders.values() if len(ids) > 1 for i in ids}
    assert want == {5, 7, 40, 41, 44, 47, 50}
    rows = repeats.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert want <= {r.doc_id for r in rows} | {r.other_doc_id for r in rows}
    label = {r.doc_id: r.class_id for r in rows} | {r.other_doc_id: r.class_id for r in rows}
    assert all(len({label[i] for i in ids}) == 1 for ids in holders.values() if len(ids) > 1)


def test_changed_passages_of_middle_documents(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    docs, pairs = [], []

    def doc(i, inner=()):
        own = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        own[30:30] = inner
        docs.append((i, " ".join(own)))

    for k in range(8):
        shared = [rng.choice(words) for _ in range(78)]
        one, two = list(shared), list(shared)
        # the two agree in stretches of 18 words; parts of these stand in documents of lower and of higher ids, not two in one
        for at in range(18, 78, 20):
            two[at:at + 2] = ["changed", f"here{at}"]
        if k == 7:
            # and one that is written again and again, with changes
            one, two = (line * 4 for line in (shared[:24], [*shared[:19], "other", *shared[20:24]]))
        pairs.append((200 + 2 * k, 201 + 2 * k))
        doc(200 + 2 * k, one)
        doc(201 + 2 * k, two)
        for n, at in enumerate(range(0, 60, 20)):
            doc(k * 3 + n, shared[at:at + 18])
            doc(400 + k * 3 + n, shared[at:at + 18])
    rows = repeats.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.other_doc_id, r.doc_id) for r in rows} | {(r.doc_id, r.other_doc_id) for r in rows} >= set(pairs)
    label = {r.doc_id: r.class_id for r in rows} | {r.other_doc_id: r.class_id for r in rows}
    assert set(label) == {i for pair in pairs for i in pair} and all(label[a] == label[b] == a for a, b in pairs)
    assert all(r.identity >= 0.8 and min(r.end_word - r.first_word, r.other_end_word - r.other_first_word) >= 50 for r in rows)


def test_passages_of_given_documents(spark):
    rows = entry.queries()["op10_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    got = {r.doc_id for r in rows} | {r.other_doc_id for r in rows}
    held: dict = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        w = (r.text or "").lower().split()
        for i in range(len(w) - 49):
            held.setdefault(tuple(w[i:i + 50]), set()).add(r.doc_id)
    assert got >= {d for v in held.values() if len(v) > 1 for d in v}


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    last = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append(len(rows))
        if name != "token ids":
            assert docs.columns == last
    assert sizes[0] > sizes[1] >= sizes[2] and sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, folder).count() == sizes[4]


def test_pipeline_stages_with_other_columns(spark, odd_documents):
    """Columns that clash with those of the stages, and none for the number of characters."""
    import corpus_pipeline

    docs = odd_documents.selectExpr("*", "1 as __gone", "2 as gone", "'d' as domain", "3 as n_tokens", "4 as epoch", "5 as taken", "6 as `__tokens`", "7 as `row`", "8 as `a.b`")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["n-gram Jaccard join"](spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 7, 9}
    mixed = stages["mixing sources"](spark, docs, "/root/testdata/sf0.001")
    rows = mixed.collect()
    assert mixed.columns == docs.columns and all(r.domain == "d" and r["a.b"] == 8 and r["row"] == 7 for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
