from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and blank texts, ties, repeated rows, one very long text, columns that clash with ours."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "src0"), (2, None, "en", None), (3, "", None, "src1"), (4, " \n\t ", "de", "src1"),
        (5, "One TWO three four five six seven eight nine ten eleven twelve", "en", "src0"), (5, "One TWO three four five six seven eight nine ten eleven twelve", "en", "src0"),
        (None, "one two three four five six seven eight nine ten eleven twelve", "en", "src0"), (7, long, "en", "src2"), (8, long + " tail", "en", "src2"), (9, "été naïve 東京", "fr", "src3"),
    ]
    rows = [(*r, 1, "a", 2.0, "b") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, sig string, label double, `bit` string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
