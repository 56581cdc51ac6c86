from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and clashing extra columns."""
    long_text = "alpha beta gamma delta " * 20_000 + "Z" * 5_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 3),
        (2, "The quick  brown\tfox jumps over the lazy dog", "en", "a", 3),
        (2, "The quick  brown\tfox jumps over the lazy dog", "en", "a", 3),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, " \t\n ", "de", "b", 0),
        (None, "Der schnelle braune Fuchs", "de", None, 1),
        (None, "Der schnelle braune Fuchs", "de", None, 1),
        (7, long_text, "en", "a", len(long_text)),
        (8, "日本語 Ünïcode ²³ 😀 \x1c", None, "c", 9),
        (9, "!!! 123 ...", "en", "c", 1),
        (10, "Licensed under CC BY-NC 4.0.\nall rights reserved cc by cc by", "en", "d", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ("kept", "size", "ids", "decoded", "lang_pred", "lang_score", "shard", "times", "key", "fp", "label", "row")
    return df.selectExpr("*", *[f"'x' AS {c}" for c in clash])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
