"""Tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest
from pyspark.sql import functions as F

TEXTS = [
    (1, "The cat sat on the mat, and the DOG ran."),
    (2, "the cat sat on the mat, and the dog ran."),
    (3, None),
    (4, ""),
    (5, " lead  two\n\n x <|endoftext|>b <|endoftext|> q.\x1cz   end "),
    (6, "Don't A.B, c... 12345 ÉÀ. é x́. ΑΣ. İI. 漢字　かな"),
    (7, "<|startoftext|>hey <|endoftext|>."),
    (8, "  "),
    (9, "\n"),
    (10, "a▁b ▁ c  "),
    (11, "word " * 40_000),
    (12, "x" * 200_000),
    (13, "\x00 a\x00b"),
    (13, "\x00 a\x00b"),
    (13, "another text of the same id"),
    (None, "a text without an id"),
    (15, "the cat sat on the mat, and the dog ran. "),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Extra columns carry the names that operators use inside."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    return df.withColumn("line", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("h", F.lit(0)).withColumn("digest", F.lit(2)).withColumn("block", F.lit(3)).withColumn("part", F.lit(4)).withColumn("locator", F.lit("l"))


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
