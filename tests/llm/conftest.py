import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """docs(texts, ...): a documents table; langs and sources may be given."""

    def make(texts, langs=None, sources=None, ids=None):
        n = len(texts)
        rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).repartition(3) if n else spark.createDataFrame([], DOCS)

    return make


@pytest.fixture
def by_id():
    def collect(df, key="doc_id"):
        return {r[key]: r.asDict() for r in df.collect()}

    return collect
