from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id long, rate double"


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, -1, 2.0) for i, t, lang in rows], DOCS)

    return make


@pytest.fixture
def odd_rows():
    """Null id and text, empty and blank texts, ties, repeated rows, a long text."""
    long = "word and more " * 20_000
    return [(None, None, None), (1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, "same text here now", "en"), (5, "same text here now", "en"), (5, "same text here now", "en"), (6, long, "de"), (7, "é ß 漢字 🙂 ퟿", "fr"), (8, "12 34 !!", "en")]
