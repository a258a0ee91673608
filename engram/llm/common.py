"""Words, lines and tables that several operators of this folder share."""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.vectors import once
from engram.sources.shared import settled

__all__ = ["OTHER_SPACE", "documents", "lowered_words", "once", "settled", "small_batches", "space_words", "words"]

# White space of the word pattern [^\x20\x09-\x0D]+ besides the blank.
OTHER_SPACE = "\t\n\x0b\x0c\r"

WORD = r"[^\x20\x09-\x0D]+"

# Bytes of an Arrow batch; an executor holds one several times over for each of its tasks, outside its heap and in Python.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """What is run inside passes Arrow batches of ``BATCH_BYTES`` at most, one longer row alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; a null text has none."""
    blanked = F.translate(F.coalesce(text, F.lit("")), OTHER_SPACE, " " * len(OTHER_SPACE))
    return F.array_remove(F.split(blanked, " "), "")


def lowered_words(text: Column) -> Column:
    """The same words with A-Z in lower case."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = F.translate(F.coalesce(text, F.lit("")), capitals + OTHER_SPACE, small + " " * len(OTHER_SPACE))
    return F.array_remove(F.split(changed, " "), "")


def space_words(text: Column) -> Column:
    """The characters of all words of a text."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), " " + OTHER_SPACE, ""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
