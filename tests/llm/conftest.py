"""Small tables with every kind of odd row."""
import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big brown bear today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big brown bear today", "en", "a"),
    (3, None, None, None), (4, "", "en", "b"), (5, " \t\n\r\x0b\x0c ", "fr", "b"), (6, "one", "en", None),
    (7, "line one is a rather long line that stays\nline two is another long line that stays too", "en", "a"),
    (8, "line one is a rather long line that stays\nline twO is another long line that stays too", "de", "c"),
    (9, "word " * 30000, "en", "a"), (9, "word " * 30000, "en", "a"), (None, "a text without any id at all", "es", "c"),
    (None, "a text without any id at all", "es", "c"), (10, "漢字 émoji 😀 ▁mark   nbsp em\x1c.", "zh", "é"),
    (11, "mail bob.x@site.example.org, 10.0.0.300 10.1.2.3 +1 (569) 555-6633 4111 1111 1111 1111", "en", "b"),
    (-5, "### *** %%% $$$ && || <> ### *** %%%", "en", "b"), (12, "x" * 5000, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows with extra columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(TEXTS, SCHEMA)
    for name in ("size", "taken", "key", "bin", "fp", "node", "label", "line", "pos", "score", "n_words", "spans", "target"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df.selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def real_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
