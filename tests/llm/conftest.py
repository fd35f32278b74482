import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """DataFrame of (doc_id, text) rows with the columns of ``documents`` and extras with clashing names."""

    def make(rows, extra=()):
        schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in extra]])
        full = [(i, t, "en", "src0", None if t is None else len(t), *["x"] * len(extra)) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ties."""
    return [(5, "the quick brown fox, the lazy dog."), (3, None), (4, ""), (None, "no identifier here"), (5, "the quick brown fox, the lazy dog."), (7, "word " * 30_000), (8, "x" * 20_000), (9, "éß 中文 \U0001f600\n\n  two  spaces \t tab "), (-2, "the quick brown fox, the lazy dog.")]
