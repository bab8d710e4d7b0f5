import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names operators use inside, or return."""

    def add(df):
        for name in ("_id", "_text", "_row", "_words", "_key", "_gone", "_source", "_size", "fp", "n_words", "kept", "score", "host", "bucket", "size", "taken", "spans", "component_id", "entry", "vector"):
            df = df.withColumn(name, F.lit("extra"))
        return df

    return add


@pytest.fixture(scope="session")
def hard(documents):
    """Null, empty, blank, very long, tied and repeated rows, and null in every column."""
    long = " ".join("wo" + "".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(30_000))
    return documents([(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same words here"), (5, "same words here"), (6, "same words here", None), (None, "no id at all", "t"), (None, None, None)])
