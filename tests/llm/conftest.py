import pytest


@pytest.fixture(scope="module")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` rows, with columns whose names clash with those of the operators."""

    def make(rows):
        full = [(i, t, None, None, 0, 7, "x") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, component bigint, words string"
        )

    return make
