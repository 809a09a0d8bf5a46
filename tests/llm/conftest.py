import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators make or that differ in case alone.
        T.StructField("shard", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("TEXT", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)
LONG = " ".join(f"word{i % 977} other{i % 1013}" for i in range(40_000))


def rows_of(texts, source="a"):
    return [(i, t, "en", source, len(t or ""), "x", "y", "z", "w") for i, t in texts]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, an empty and a very long text, repeated rows, repeated ids, and odd characters."""
    texts = [
        (1, "the quick brown fox jumps over the lazy dog"),
        (2, None),
        (3, ""),
        (4, LONG),
        (5, "the quick brown fox jumps over the lazy dog"),
        (6, "one"),
        (7, " \n\t "),
        (8, "Ünïcödé 日本語   \x1c🙂 ΟΔΟΣ <|endoftext|> ▁x"),
        (9, "repeated row"),
        (9, "repeated row"),
        (10, "one id"),
        (10, "two texts"),
        (None, "no id"),
        (None, None),
        (11, "a b c d e f g h " * 40),
    ]
    rows = rows_of(texts)
    return [r if r[0] != 3 else (*r[:3], None, *r[4:]) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
