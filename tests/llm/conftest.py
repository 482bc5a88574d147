import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text[, source]) as a documents table."""

    def make(rows, schema=DOC_SCHEMA):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
