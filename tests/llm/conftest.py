import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, lang[, source]]) as a table of documents."""

    def build(rows, schema=DOCS):
        full = [tuple((*r, *([None] * (4 - len(r))))[:4]) + (len(r[1]) if r[1] is not None else None,) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """What may stand in a table: nulls, empty and blank texts, repeated rows, a long text, odd characters."""
    long_ = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", ""), (3, " \t\n\x0b", None, "a"), (4, "one two", "en", "a"), (None, "a b c d e f g", "en", "a"), (None, None, None, None), (5, long_, "en", "b"), (5, long_, "en", "b"), (6, "één naïve ß漢字 \x00   x y", "fr", "é"), (7, "\U0001f600 " * 7, None, "b")]
    return make(rows)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
