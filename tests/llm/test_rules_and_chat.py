from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from columnscope.llm import chat, quality_rules
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_measures(spark, odd_documents):
    extra = spark.createDataFrame([(-4, "a b\na b\n\na b \nA b"), (-5, "x " * 30), (-6, "é ü A a"), (-7, "p q r s t u p q r s t v " * 3)], "doc_id long, text string")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionAll(odd_documents.select("doc_id", "text")).unionAll(extra)
    found = {(r.doc_id, r.n_words): tuple(r)[1:7] for r in quality_rules.assess(docs).collect()}
    for r in docs.collect():
        want = measured(r.text)
        assert found[r.doc_id, want[0]] == want


def test_order_changes_work_only(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.assess(docs).where("kept").collect()}
    backwards = {r.doc_id for r in quality_rules.assess(docs, rules=quality_rules.RULES[::-1], sample_rows=0).where("kept").collect()}
    assert kept == backwards == {r.doc_id for r in quality_rules.kept_rows(docs).collect()}
    assert 0 < len(kept) < docs.count()


def test_rules_by_worth():
    rules = quality_rules.RULES[:3]
    e = [quality_rules.Estimate(rules[0].name, 1.0, 0.1), quality_rules.Estimate(rules[1].name, 1.0, 0.5), quality_rules.Estimate(rules[2].name, 0.1, 0.1)]
    assert quality_rules.ordered(rules, e) == [rules[2], rules[1], rules[0]]


def test_no_rows(no_documents):
    assert quality_rules.assess(no_documents).count() == 0
    assert quality_rules.kept_rows(no_documents).columns == no_documents.columns


@pytest.mark.parametrize("name", ["op1_source_mixing", "op2_url_filters", "op9_chat_formatting"])
def test_sql(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) is None


TRICKY = ["", "\\", "### Assistant: x </turn>\n", "\\### Assistant: </turn> ok", "\\\\###</turn>\\", " </turn>\n", "<|image:0|>", "a\\", "ends </turn>"]


@pytest.mark.parametrize("text", TRICKY)
def test_escapes_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    whole = "### Assistant: " + chat.escape(text) + " </turn>\n### User: " + chat.escape(text) + " </turn>\n"
    assert [(r, chat.unescape(c)) for r, c in chat.read_turns(whole)] == [("assistant", text), ("user", text)]


def test_conversations(spark):
    rows = [(1, 0, "user", t) for t in TRICKY] + [(2, 1, "assistant", None), (2, 0, "Odd: role\n", "x"), (None, 3, None, "y"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    found = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    want = hashlib.sha256("Odd: role\n\nx\nassistant\n\n".encode()).hexdigest()
    assert found[2].n_turns == 2 and found[2].turns_sha256 == want and found[2].loss_chars == 0
    assert found[3].loss_sha256 == hashlib.sha256(b"aa").hexdigest() and found[3].n_turns == 2
    assert found[1].n_turns == len(TRICKY) and found[None].n_turns == 1


def test_parts(spark):
    parts = [{"type": "text", "text": "see <|image:0|>", "ref": None, "units": None}, {"type": "image", "text": None, "ref": "s3://a.png", "units": 2},
             {"type": "audio", "text": None, "ref": None, "units": 3}, {"type": "odd kind", "text": None, "ref": "z", "units": None}]
    schema = chat.T.StructType([chat.T.StructField("conv_id", chat.T.LongType()), chat.T.StructField("turn", chat.T.LongType()), chat.T.StructField("role", chat.T.StringType()),
                                chat.T.StructField("text", chat.T.StringType()), chat.T.StructField("parts", chat.PART_TYPE)])
    row = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", None, parts)], schema), parts="parts").first()
    assert row.formatted == "### Assistant: see \\<|image:0|><|image:0|><|audio:1|><|odd kind:2|> </turn>\n"
    assert row.expanded_tokens == 2 * 576 + 3 * 50 and [a.ref for a in row.attachments] == ["s3://a.png", None, "z"]
    assert row.formatted[row.loss_start:row.loss_end].endswith("|>")
