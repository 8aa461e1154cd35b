import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with further columns of clashing names."""
    def make(rows):
        full = [(i, t, "xx", "s", None, "h", -1, 7, 3, "c") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, "
                  "print bigint, slot int, n bigint, score string")
    return make
