import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """Rows of documents from (doc_id, text) or (doc_id, text, source)."""
    def make(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *(["x"] * len(extra))) for r in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", {c} string" for c in extra))
    return make
