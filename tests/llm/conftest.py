import pytest

SCHEMA = "video_id long, narrative string, category string, lang string, c int, key string, size double, score int, n int, _text string, `a b` int"


@pytest.fixture(scope="session")
def narratives(spark):
    """Builds rows of (video_id, narrative, category, lang), with further columns whose names clash."""

    def make(rows):
        rows = [tuple(r) + (None,) * (4 - len(r)) + (7, "k", 0.5, 3, 4, "t", 5) for r in rows]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as video_id", "text as narrative", "source as category", "lang")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows and a very long text."""
    long = "the camera shows a person who walks along the wall " * 4000
    return [
        (1, "a person enters the hall and leaves", "x", "en"), (1, "a person enters the hall and leaves", "x", "en"), (2, "", "x", "en"), (3, None, None, None),
        (4, " \t\n ", "y", "en"), (None, "no id is given here", "y", None), (None, None, None, None), (5, long, "x", "en"), (6, "été à la mer", None, "fr"),
        (1, "another text under the same id", "x", "en"), (7, "123 456 !!", "z", None),
    ]
