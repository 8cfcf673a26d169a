import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names clash with results."""
    long = "The quick brown fox jumps over the lazy dog, number 7.\n" * 4000
    rows = [
        (1, "A text about the cat that sat on the mat.", "en", "a", 41, 5, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 1, "y"),
        (4, "A text about the cat that sat on the mat.", "en", "b", 41, 5, "x"),
        (4, "A text about the cat that sat on the mat.", "en", "b", 41, 5, "x"),
        (None, "Ein Text ohne Nummer, aber mit +1 (462) 555-7216.", "de", "b", 20, 2, "z"),
        (5, long, "en", None, len(long), 3, "x"),
        (6, "12 34 !!", None, "c", 8, 1, "x"),
        (7, " \t\n ", "fr", "c", 4, 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, component_id string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
