import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside, as columns a table may bring along.
CLASHING = ("score", "size", "n", "key", "digest", "ids", "component", "first", "label", "uid", "__key", "kept")


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts or (doc_id, text) pairs, with columns whose names clash."""

    def make(rows, source="s"):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, None, source, len(t or "")) for i, t in pairs], DOCS)
        return df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
