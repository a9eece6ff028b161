import pytest

LONG = "word " * 30_000 + "mail a.b@c.de " + "x" * 50_000

#: Nulls, empty and very long texts, repeated rows and ids, and other columns under names that operators use inside.
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "key", "w"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "key", "w"),
    (2, None, None, None, None),
    (3, "", "en", None, None),
    (None, "an orphan row", "en", "k", "v"),
    (None, None, None, None, None),
    (4, LONG, "en", None, None),
    (5, "  \n\t ", "de", None, None),
    (6, "Überraschung! 12 €, 中文, \U0001f600 don't", "de", None, None),
    (7, "!!! ???", None, None, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, lang string, key string, value string").withColumnRenamed("value", "label")


@pytest.fixture(scope="session")
def nothing(spark, edges):
    return spark.createDataFrame([], edges.schema)
