import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string"
PHRASE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, wordless and very long texts, ties, repeated rows, and extra columns named like results."""
    rows = [
        (1, None, "en", "a", None, "x", "y"), (2, "", None, None, 0, None, None), (3, " \n\t ", "en", "a", 3, "x", "y"), (4, PHRASE, "en", "a", 1, "x", "y"), (5, PHRASE, "en", "a", 1, "x", "y"),
        (5, PHRASE, "en", "a", 1, "x", "y"), (None, PHRASE, "de", None, 1, None, None), (6, "word " * 60_000, "en", "b", 1, "x", "y"), (7, "ÄÖÜ ß 東京 \u200b🙂 \x1c it's <|endoftext|>", "de", "b", 1, "x", "y"), (8, "You IDIOT!!! " * 5, "en", "b", 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 1), (8, 0, 1), (None, 1, 1), (9, None, None), (1, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
