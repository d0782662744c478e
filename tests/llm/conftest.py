from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    lines = "first line here\nsecond line here\nthird line here"
    rows = [
        (1, lines, "en", "a", 10, "x", "k"),
        (2, lines, "en", "a", 10, None, None),
        (2, lines, "en", "a", 10, None, None),
        (2, "another text under the same id", "en", "a", None, "y", "k"),
        (3, None, "en", None, None, None, None),
        (4, "", None, "a", 0, None, None),
        (5, " \n\t ", "de", "b", 3, None, None),
        (6, long, "de", "b", len(long), "x", None),
        (7, "<|endoftext|>a b<|startoftext|> é 中文 👍🏽 \x1c\x00", None, None, None, None, None),
        (None, "a row without an id", "en", "a", 5, None, None),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
