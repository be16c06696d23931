import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as documents, with other columns whose names clash with those of the operators."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score string, fp string, id bigint"

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "s", len(t or ""), True, "x", "y", 7) for d, t in rows], schema)

    return make
