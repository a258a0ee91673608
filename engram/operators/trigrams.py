"""Text search for many patterns at once, by posting lists of trigrams.

A pattern is found as ``ilike '%pattern%'`` finds it: without regard to case,
``%`` for any characters, ``_`` for one and a backslash before a character that
stands for itself.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.sources.shared import settled

MAX_SHORT = 1000


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters, in lower case, in one pass over the characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def holds(text: Column, pattern: Column) -> Column:
    """``text ILIKE '%pattern%'`` in time linear in the text, but for patterns with escapes.

    A pattern without wildcards is searched for as it is. Else the stretches
    between its ``%`` are found one after the other, each at its first place
    behind the one before: atomic groups, which are never tried again.
    """
    lower, low = F.lower(text), F.lower(pattern)
    quoted = F.regexp_replace(low, r"[^%_]+", r"\\Q$0\\E")
    groups = F.regexp_replace(F.replace(quoted, F.lit("_"), F.lit(".")), "%", ")(?>.*?")
    found = F.regexp(lower, F.concat(F.lit(r"(?s)\A(?>.*?"), groups, F.lit(")")))
    whole = F.ilike(text, F.concat(F.lit("%"), pattern, F.lit("%")))
    return F.when(F.contains(pattern, F.lit("\\")), whole).when(pattern.rlike("[%_]"), found).otherwise(F.contains(lower, low))


def trigrams(facts: DataFrame, key: str = "fact_id", text: str = "fact") -> DataFrame:
    """(gram, key): which texts have which runs of three characters; to be written once and kept with the texts."""
    return facts.where(F.col(text).isNotNull()).select(F.explode(grams_of(F.col(text))).alias("gram"), key)


def facts_by_patterns(
    facts: DataFrame, grams: DataFrame, patterns: DataFrame, key: str = "fact_id", text: str = "fact"
) -> DataFrame:
    """(pattern, and the columns of ``facts``) of every fact that contains a pattern of ``patterns``.

    A text that contains a pattern has all its trigrams, so only the texts in
    the shortest posting list among them are looked at, and each is compared
    with the whole pattern. Patterns without a run of three fixed characters
    have no list; up to MAX_SHORT of them are compared with every text in one
    scan. Null patterns find nothing.
    """
    wanted = settled(patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct(), "patterns")
    # Escaped characters and wildcards end a fixed stretch: fewer trigrams, never wrong ones.
    stretches = F.split(F.col("pattern"), r"\\.|[%_]")
    fixed = F.array_distinct(F.flatten(F.transform(stretches, grams_of)))
    listed = wanted.withColumn("grams", fixed)
    long = listed.where(F.size("grams") > 0).select("pattern", F.explode("grams").alias("gram"))
    sizes = grams.join(long.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = long.join(sizes, "gram", "left")
    rarest = counted.groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    # Written out, so that they meet the lists and the texts by their size.
    candidates = settled(grams.join(settled(rarest, "rarest"), "gram").select("pattern", key), "candidates")
    found = candidates.join(facts, key).where(holds(F.col(text), F.col("pattern"))).select("pattern", *facts.columns)

    short = [r["pattern"] for r in listed.where(F.size("grams") == 0).limit(MAX_SHORT + 1).collect()]
    if len(short) > MAX_SHORT:
        raise ValueError(f"more than {MAX_SHORT} patterns without three fixed characters")
    if not short:
        return found
    hits = F.array_compact(F.array(*[F.when(holds(F.col(text), F.lit(p)), F.lit(p)) for p in short]))
    return found.unionByName(facts.select(F.explode(hits).alias("pattern"), *facts.columns))

