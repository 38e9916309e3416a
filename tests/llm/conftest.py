import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names may clash."""
    rows = [
        (1, None, None, None, 1),
        (2, "", "en", "a", 2),
        (3, "the cat sat on the mat with the other cats of the town", "en", "a", 3),
        (4, "the cat sat on the mat with the other cats of the town", "en", "b", 4),
        (4, "the cat sat on the mat with the other cats of the town", "en", "b", 4),
        (5, "12345 ... !!", "de", "a", 5),
        (6, "wort " * 60_000, "de", "c", 6),
        (7, "x" * 700_000, "fr", None, 7),
        (8, "été façon garçon très bien voilà où", "fr", "a", 8),
        (None, "nobody knows this text of unknown origin", "en", "a", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
