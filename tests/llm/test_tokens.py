from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from columnscope.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_boundaries_round_trip(sizes):
    want = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    width, high, low, directory = token_files.encode_boundaries(want)
    held = token_files.Boundaries(len(want), width, np.frombuffer(high, np.uint8), np.frombuffer(low, np.uint8), directory)
    assert (held.all() == want).all() and [held[i] for i in range(len(want))] == want.tolist()
    n, u = len(want), max(int(want[-1]), 1)
    assert 8 * (len(high) + len(low)) <= n * (3 + max(0, np.log2(u / n))) + 16


def test_segments():
    ids = np.arange(1000, dtype="<u2")
    segment = token_files.Segment(token_files.encode_segment(ids, np.array([0, 0, 10, 1000])))
    assert len(segment) == 3 and [len(segment[i]) for i in range(3)] == [0, 10, 990] and (segment[2] == ids[10:]).all()
    with pytest.raises(ValueError):
        token_files.Segment(b"x" * 60)


TEXTS = ["<|endoftext|> a b", "a  b", "\n\na", "a\n\nb c", "it's 'll we 've  ", "", " a b", "a \n b", "tab\tx", "'s a 't", "é b", "a\u0085b", "\x01a b", "a\x1cb c", "x y z", "東京 ٣ x2", "a\r\nb c", "one two\nthree"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text(st.sampled_from("ab 'sl\n\t é1.\r"), max_size=30)), max_size=6))
def test_words_encode_as_whole_texts(texts):
    plain = Tokenizer.from_file(PATH) if not hasattr(test_words_encode_as_whole_texts, "t") else test_words_encode_as_whole_texts.t
    test_words_encode_as_whole_texts.t = plain
    found = token_files.Encoder.of(PATH).encode(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def expected(rows):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for name, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    found = entry.queries()["op3_token_id_output"](spark, folder)
    assert sorted(map(tuple, found.collect())) == expected(rows)


def test_odd_rows(odd_documents, no_documents, tmp_path):
    segments = token_files.write_tokens(odd_documents, f"{tmp_path}/a", PATH, segment_ids=20)
    found = sorted(map(tuple, token_files.document_facts(segments).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text) for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert found == expected(rows) and segments.count() > 3
    assert token_files.document_facts(token_files.write_tokens(no_documents, f"{tmp_path}/b", PATH)).count() == 0
