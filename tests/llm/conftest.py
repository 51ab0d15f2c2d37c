import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \t\n ", "fr", "b", 3),
        (5, "the quick brown fox jumps", "en", None, 1),
        (5, "the quick brown fox jumps", "en", None, 1),
        (None, "le petit chat", "fr", "c", 2),
        (7, "mot " * 9000, "fr", "c", None),
        (8, "été <|endoftext|> \U0001f600\x00x", None, "\U0001f600", 5),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("_rank", F.lit("mine")).withColumn("length", F.lit("clash")).withColumn("shard", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
