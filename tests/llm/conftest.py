import pytest


@pytest.fixture
def docs(spark):
    """A frame of documents with clashing extra columns from (doc_id, text, lang, source) tuples."""
    def make(rows):
        full = [(r + (None,) * 4)[:4] + (len(r[1] or ""), "x", "y", 7) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp string, shard string, u int")
    return make
