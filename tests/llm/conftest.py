import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls everywhere, empty and very long texts, ties, repeated rows and clashing column names."""
    long_text = "the long text goes on and on with words " * 4000 + "token = abcdefgh12345678 the end"
    rows = [
        (1, None, "en", None, None, None, None, None), (2, "", "en", "a", 0, 0.0, "x", "y"),
        (3, long_text, "en", "a", len(long_text), 1.0, "x", "y"), (4, long_text, None, "a", 1, 1.0, None, "y"),
        (5, "a b", "en", "a", 3, 1.0, "x", None), (5, "a b", "en", "a", 3, 1.0, "x", None),
        (None, "a b", "fr", "a", 3, 1.0, "x", "y"), (None, None, None, None, None, None, None, None),
        (7, "  \n\t ", "en", "a", 5, 1.0, "x", "y"), (8, "1234 !!! ###", "en", "a", 5, 1.0, "x", "y"),
        (9, "le texte est en français et il est beau", "fr", "a", 5, 1.0, "x", "y"),
        (10, "le texte est en français et il est laid", "fr", "a", 5, 1.0, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
