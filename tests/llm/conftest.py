import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PLAIN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 4

# Columns that operators use for themselves or return.
CLASHES = ["score", "kept", "start", "n", "node", "h1", "label", "text_hash", "component", "w", "lines", "bucket",
           "budget", "epoch", "key", "payload", "site", "n_lines", "n_removed", "kept_spans", "refers_to", "block", "pieces",
           "ids", "sequence_id", "vector", "x"]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in CLASHES]])

TEXTS = [
    (1, PLAIN), (2, PLAIN), (2, PLAIN), (3, PLAIN.upper()), (4, None), (5, ""), (6, " \t\n\r\x0b\x0c "), (7, "word"),
    (8, LONG), (9, LONG + " more"), (None, PLAIN), (None, None), (10, "été 你好 \U0001f600 naïve\n\nline\nline"),
    (11, "a b  c   d\n e\t f"), (12, "<|endoftext|> and <|endoftext|>")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rows = [(i, t, None if k % 4 == 3 else "en", None if k % 5 == 4 else f"src{k % 3}", None if t is None else len(t),
             *["x"] * len(CLASHES)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, testdata):
    return spark.read.parquet(f"{testdata}/sf0.001/documents.parquet")
