import pytest


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as a table with the columns of documents and one that clashes with inner names."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, Name string").repartition(3)

    return make


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
