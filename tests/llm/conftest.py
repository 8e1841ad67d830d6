import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (ids from 0) or from (id, text) pairs, with columns whose names clash with the operators' own."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2, [1]) for i, t in rows]
        return spark.createDataFrame(rows, DOCS + ", key int, hits string, score int, runs array<int>")

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
