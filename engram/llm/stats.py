"""Counts over a whole text, as DataFrame expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import WORD, once, space_words, words

SYMBOLS = "#*$%&|<>"
POSITION_BITS = 31


def repeated_window_words(found: Column) -> Column:
    """How many words lie in a window of three words found twice or more in the array."""
    return once(found, repeated_in)


def repeated_in(found: Column) -> Column:
    """The count for an array that is a variable: it is looked into at every step.

    Windows are sorted as numbers, 33 bits of a hash above the position, so
    that windows that may be equal stand side by side; only those are compared
    as strings. That takes n log n steps, also for a text of one repeated word.
    """
    start = F.size(found) - 3
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")
    numbered = F.transform(
        F.sequence(F.lit(0), start),
        lambda i: F.shiftleft(F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)), POSITION_BITS)
        .bitwiseOR(i.cast("long")),
    )

    def beside(items: Column, key) -> Column:
        return F.filter(
            items,
            lambda x, i: (key(F.get(items, i - 1)) == key(x)) | (key(F.get(items, i + 1)) == key(x)),
        )

    def window(x: Column) -> Column:
        i = x.bitwiseAND(low).cast("int")
        return F.struct(F.concat_ws(" ", F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)).alias("w"), i.alias("i"))

    alike = once(F.sort_array(numbered), lambda s: beside(s, lambda x: F.shiftright(x, POSITION_BITS)))
    equal = once(
        alike,
        lambda c: F.when(F.size(c) == 0, F.array().cast("array<struct<w:string,i:int>>")).otherwise(
            once(F.sort_array(F.transform(c, window)), lambda s: beside(s, lambda x: x["w"]))
        ),
    )
    places = F.sort_array(F.transform(equal, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return F.when(start >= 1, covered).otherwise(F.lit(0).cast("long"))


def with_counts(df: DataFrame, text: str, *kept: Column) -> DataFrame:
    """The ``kept`` columns of each row and its counts, all long.

    n_words, word_chars (code points in words), n_symbols (characters of
    ``#*$%&|<>``), n_lines (lines with a word), n_dup_lines (of these, equal to
    an earlier one), n_repeat_words, n_distinct_words, n_upper (upper-case
    letters), n_exclaimed, n_digits, n_ended_lines (lines ending a sentence).
    A null or empty text has zeros; the kept columns should have other names.
    """
    split = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("counted_body"))
    names = split.columns[:-1]
    split = split.select(
        *names,
        "counted_body",
        words(F.col("counted_body")).alias("found"),
        F.filter(F.split("counted_body", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    length = F.length("counted_body")

    def without(characters: str) -> Column:
        return (length - F.length(F.translate("counted_body", characters, ""))).cast("long")

    ended = F.filter("lines", lambda x: x.rlike(r"[.!?…][\"')\]”’»]*[\x20\x09-\x0D]*$"))
    return split.select(
        *names,
        F.size("found").cast("long").alias("n_words"),
        space_words(F.col("counted_body")).cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("found")).alias("n_repeat_words"),
        F.size(F.array_distinct("found")).cast("long").alias("n_distinct_words"),
        (length - F.length(F.regexp_replace("counted_body", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        without("!").alias("n_exclaimed"),
        without("0123456789").alias("n_digits"),
        F.size(ended).cast("long").alias("n_ended_lines"),
    )


def text_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the counts of each row; no other column of the input is looked at."""
    return with_counts(df, text, F.col(key))
