import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source, n_chars) with columns whose names clash with those of results."""

    def make(rows, **more):
        rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        clash = {"kept": F.lit("x"), "row": F.lit(1), "size": F.lit("y"), "score": F.lit(None).cast("int")}
        return df.withColumns(clash) if more.get("clash", True) else df

    return make


#: Nulls in any column, empty, blank and long texts, ties and repeated rows.
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "no number here but some words to be found", "b"),
       (5, "same words in a row of five and more", "a"), (5, "same words in a row of five and more", "a"),
       (6, "same words in a row of five and more", None), (7, "word " * 30_000, "b"), (8, "x", "a"), (8, "y", "a")]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
