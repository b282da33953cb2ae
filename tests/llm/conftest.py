import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, h1 string"


@pytest.fixture
def docs_of(spark):
    """A table of documents from (doc_id, text[, lang, source]) with null and clashing columns."""
    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return build
