import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SF_LABELLED = "/root/testdata/sf0.01"

#: Further columns whose names the operators use themselves.
CLASHING = ["score", "node", "key", "shingle", "item", "text_hash", "cell", "component", "number", "tails", "label", "id", "a", "word"]


def docs_frame(spark, rows):
    """(doc_id, text) rows with lang, source, n_chars and the clashing columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    full = [(d, t, None if t is None else ("en" if (d or 0) % 2 else "de"), None, None, *["x"] * len(CLASHING)) for d, t in rows]
    return spark.createDataFrame(full, schema)


BASE = "the quick brown fox jumps over the lazy dog near the old river bank while birds sing in green trees"
EDGE_ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.upper()), (4, None), (5, ""), (6, "   \n\t "), (7, "one"),
    (8, "1234 5678 !!"), (None, BASE), (None, None), (9, "Released under the MIT License. " + BASE),
    (10, " ".join(f"w{i}" for i in range(30_000))), (11, "ünïcödé ▁ mark \U0001f600 " * 3), (12, "x" * 50_000), (12, "other text"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return docs_frame(spark, EDGE_ROWS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
