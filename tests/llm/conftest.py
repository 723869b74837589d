import pytest

LONG = "lorem ipsum dolor " * 40_000
ODD_TEXTS = [None, "", " ", "\n\n", "a", "  two  spaces ", "ünïcode \U0001f642 text", "same text", "same text", LONG]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, very long and repeated texts, a repeated row, a null id, clashing columns."""
    rows = [(i, t, "x", None) for i, t in enumerate(ODD_TEXTS)] + [(4, "a", "x", None), (None, "no id here", "y", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, range double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
