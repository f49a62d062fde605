import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and white texts, a long text, ties, repeated rows, repeated ids.
ODD = [
    (None, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, " \t\n\x0b ", "en", "a", 5),
    (3, "one two three four five six", "en", "b", 27),
    (4, "one two three four five six", None, "b", 27),
    (4, "one two three four five six", None, "b", 27),
    (5, "ONE two three  four five six", "en", None, 28),
    (6, "x" * 70_000, "en", "c", 70_000),
    (7, "Straße İstanbul ΣΑΣ 中文 \U0001f600 é <|endoftext|> it's", "de", "c", 1),
    (8, "line one is here\nline two is here\n\nline one is here\nline two is here", "en", "d", 1),
    (9, "word " * 30_000, "en", "d", 1),
    (None, "no id at all", "en", "e", 1),
]


@pytest.fixture(scope="session")
def docs(spark: SparkSession):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="session")
def odd(spark: SparkSession):
    """Odd rows with extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *(F.lit(c).alias(c) for c in ("ids", "fp", "rid", "size", "block", "shard", "kept", "_rid", "pos", "head")))


@pytest.fixture(scope="session")
def none(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)
