import pytest
from pyspark.sql import types as T

LONG = "Some words of a long text, then a token = \"abcdef0123456789abcdef0123456789\" here. " * 3000

EDGE = [
    (1, "a small text with enough words to be a text of its own kind", "en", "s1"),
    (1, "a small text with enough words to be a text of its own kind", "en", "s1"),  # a repeated row
    (2, "a small text with enough words to be a text of its own kind", None, None),
    (3, "A small text with enough words to be a text of its own  kind", "en", "s1"),
    (3, "another text under the same id", "en", "s2"),
    (4, None, "en", "s1"),
    (5, "", "de", "s1"),
    (6, " \t\n\x0b\x0c\r ", None, "s1"),
    (7, LONG, "en", "s2"),
    (8, LONG + "x", "en", "s2"),
    (None, "a text without an id", "en", "s1"),
    (None, "a text without an id", "en", None),
    (9, "日本語のテキスト é ẞ İ \u0000 ​ 😀", "ja", "s3"),
    (10, "word", "en", "s3"),
    (-11, "<|endoftext|> special <|startoftext|>  signs", "en", "s3"),
]
#: Names that operators use inside themselves, and one with a dot.
CLASH = ["key", "digest", "kept", "fp", "host", "n", "component", "at", "path", "ids", "a.b", "weft_id"]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with NULLs, empty and long texts, ties, repeated rows and columns of clashing names."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in CLASH if c != "weft_id"]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * (len(CLASH) - 1)) for r in EDGE], T.StructType(fields))


@pytest.fixture(scope="session")
def no_rows(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
