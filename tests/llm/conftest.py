import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A few documents with every kind of oddity: nulls, empty, repeated rows, ties, a long text, clashing columns."""
    long = " ".join(f"word{i % 997}x" for i in range(60_000))
    rows = [
        (1, "One two three four five six.\nSecond line here.", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, "One two three four five six.\nSecond line here.", "en", None, 10),
        (4, "One two three four five six.\nSecond line here.", "en", None, 10),
        (5, " \n\t\n ", "de", "b", 5),
        (6, long, "en", "a", len(long)),
        (7, "Ünïcode ß 字 \U0001f600\r\nx", "de", "c", 9),
        (None, "no id", None, None, None),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", h string, label long")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
