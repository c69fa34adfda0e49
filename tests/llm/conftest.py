import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(doc_id, text), ...]) -> a documents frame with two extra columns."""
    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        full = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, schema)
    return make
