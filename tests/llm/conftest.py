import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls in every column, empty and long texts, copies, a repeated row, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at night"
    rows = [
        (1, base, "en", "a", 10, "x"), (2, base, "en", "a", None, None), (3, base + " again", "en", "b", 5, "x"), (4, None, None, None, None, None), (5, "", "en", "b", 0, "x"),
        (6, "word " * 30_000, "en", "a", 150_000, "x"), (None, base, "en", "c", 1, "x"), (8, "une phrase tout autre avec ses propres mots et rien de plus", "fr", "c", 60, "x"), (8, "une phrase tout autre avec ses propres mots et rien de plus", "fr", "c", 60, "x"), (9, "12 34 !!", "en", None, 8, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


@pytest.fixture(scope="session")
def empty(spark, documents):
    return documents.where("false")
