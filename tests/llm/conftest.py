from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a repeated id, and extra columns whose names operators use."""
    word = "lorem ipsum dolor sit amet, consectetur adipiscing elit. "
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "One TWO three"), (6, word * 4000), (7, word * 4000 + "end."), (8, "a" * 100_000),
        (None, "no id here at all, but ten words of text anyway."), (9, "Ünïcödé 日本語   text with wide spaces <|endoftext|> and it's x"), (10, "line one.\nline one.\n\nline two | | |\n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "cast(null as string) as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as score", "'x' as kept", "2 as n_words", "3 as data", "4 as `key`", "5 as `a.b`")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
