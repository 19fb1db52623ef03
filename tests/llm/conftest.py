import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table like ``documents`` from (doc_id, text) pairs, with further columns whose names operators use."""
    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words long")
    return make
