import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."),
    (2, "The quick brown fox jumps over the lazy dog and runs away."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "one"),
    (7, "a b c"),
    (8, "line of five words here\nline of five words here\n# $ % |"),
    (9, "word " * 30_000),
    (10, "x" * 100_000),
    (11, "tie"),
    (11, "tie"),
    (12, "naïve ΑΣ 日本語 <|endoftext|> 's \x1c end́"),
    (None, "no id"),
]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that are null, empty, long, equal or repeated, with columns whose names the operators use themselves."""
    rows = spark.createDataFrame(TEXTS, SCHEMA)
    clashes = ["n", "node", "tokens", "key", "rank", "length", "salt", "score", "n_words", "found", "ids", "row", "body", "slot"]
    return rows.selectExpr("*", *(f"'clash' AS {c}" for c in clashes), "CAST(NULL AS STRING) AS source")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
