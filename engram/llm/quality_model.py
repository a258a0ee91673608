"""A quality classifier learnt from trusted positives and unlabelled text."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.linear import fit_nonnegative_pu
from engram.llm.stats import with_counts

SAMPLE_ROWS = 20_000  # of trusted positives, and as many unlabelled ones


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features() -> Column:
    """Numbers of the text alone: sizes and shares over the columns of ``text_counts``."""

    def share(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))

    shares = [
        share("n_symbols", "n_words"),
        share("n_upper", "word_chars"),
        share("n_exclaimed", "n_words"),
        share("n_repeat_words", "n_words"),
        share("n_dup_lines", "n_lines"),
        share("n_digits", "word_chars"),
    ]
    rest = [
        F.log1p("n_words"),
        F.log1p(share("n_words", "n_lines")),
        F.least(share("word_chars", "n_words"), F.lit(20.0)),
        share("n_distinct_words", "n_words"),
        share("n_ended_lines", "n_lines"),
    ]
    bent = [f(F.least(s, F.lit(1.0))) for s in shares for f in (lambda s: s, F.sqrt, lambda s: F.least(s * 20, F.lit(1.0)))]
    return F.array(*bent, *rest)


def sample(df: DataFrame, keys: DataFrame, key: str, text: str, rows: int) -> np.ndarray:
    """The features of the rows of at most ``rows`` keys, chosen by a hash of the key."""
    chosen = keys.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(rows)
    texts = df.select(key, text).join(F.broadcast(chosen.distinct()), key)
    counted = with_counts(texts, text, F.col(key)).select(key, features().alias("x"))
    found = counted.groupBy(key).agg(F.min("x").alias("x")).collect()  # of repeated keys one row
    return np.array([r["x"] for r in found], float)


def fit_quality(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> np.ndarray | None:
    """Weights over ``features`` and, last, the constant; None without trusted positives.

    Trusted positives are rows that ``labels`` marks 1 (of repeated labels the
    highest counts), unlabelled ones are taken from all rows without regard to
    labels. Held-out rows give neither positives nor the class prior, which is
    estimated as the share of positives among the other labelled rows. At most
    ``sample_rows`` keys of each kind are learnt from.
    """
    usable = labels.where(F.col(quality).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(quality).alias("mark"))
    good = F.coalesce(F.sum((F.col("mark") == 1).cast("long")), F.lit(0))
    marks = usable.agg(F.count("*").alias("n"), good.alias("good")).first()
    positive = sample(df, usable.where("mark = 1").select(key), key, text, sample_rows)
    unlabelled = sample(df, df.select(key), key, text, sample_rows)
    if not len(positive) or not len(unlabelled):
        return None
    prior = (marks["good"] + 1) / (marks["n"] + 2)
    centre, spread = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-6)
    weights = fit_nonnegative_pu((positive - centre) / spread, (unlabelled - centre) / spread, prior)
    scaled = weights[:-1] / spread
    return np.append(scaled, weights[-1] - (scaled * centre).sum())


def quality_scores(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    cut: float = 0.7,
) -> DataFrame:
    """row (all columns of ``df``), held_out, score (0 to 1, higher: good likelier) and predicted, for each row's whole text.

    The fit is on a bounded sample on the driver (``fit_quality``); the scores
    of all rows are expressions of their text alone, so no row is moved. Null
    and empty texts are scored as texts without words; a null key is not held
    out and has no label. Repeated rows are scored each. Without trusted
    positives every score is 0.5. An empty table gives no rows.
    """
    weights = fit_quality(df, labels, key, text, quality, sample_rows)
    z = F.lit(0.0)
    counted = with_counts(df, text, F.struct(*df.columns).alias("row"))
    if weights is not None:
        z = F.aggregate(
            F.zip_with(features(), F.array(*(F.lit(float(w)) for w in weights[:-1])), lambda a, b: a * b),
            F.lit(float(weights[-1])),
            lambda s, v: s + v,
        )
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    # The one-element explode keeps a later condition on the score from being worked out a second time below it.
    scored = counted.select("row", held_out(F.col(f"row.`{key}`")).alias("held_out"), F.explode(F.array(score)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
