import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with inner ones."""
    long = "word " * 30000 + "end."
    rows = [
        (1, None, None, "a"), (2, "", "en", "b"), (3, "   \n\t ", "en", "c"), (4, long, "en", "d"), (5, "Hello world, mail a.b@c.example now", None, "e"),
        (5, "Hello world, mail a.b@c.example now", None, "e"), (6, "Hello world, mail a.b@c.example now", "fr", "f"), (None, "no id here", "de", "g"), (7, "!!! 123 ...", "de", "h"), (8, "é😀漢字 ▁mark x", "es", "i"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.select("*", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("digest"), F.lit("x").alias("base"), F.lit("y").alias("score"), F.lit("z").alias("key"), F.lit(0).alias("shard"), F.lit(0).alias("found"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
