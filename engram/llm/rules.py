"""Quality rules as weak supervision: rules vote or abstain, a latent class decides."""

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from engram.llm.common import settled
from engram.llm.stats import text_counts

# The believed accuracy of a bad (-1) and of a good (1) vote, which weighs BELIEF times the votes cast, and
# the share of good texts. A rule that fires alone meets no other rule that could confirm it.
ACCURACY = {-1: 0.95, 1: 0.85}
BELIEF = 2.0
GOOD = 0.8
ROUNDS = 60


def three(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """The rules over the columns of ``text_counts``; without words every rule but the first abstains."""
    n = F.col("n_words")
    some = n > 0
    never = F.lit(False)
    return {
        "length": three(n < 20, n >= 50),
        "symbols": three(some & (F.col("n_symbols") * 10 > n * 3), never),
        "lines": three(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, never),
        "repeats": three(some & (F.col("n_repeat_words") * 10 > n * 3), never),
        "word_length": three(
            some & ((F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 15)),
            some & (F.col("word_chars") >= n * 3) & (F.col("word_chars") <= n * 10),
        ),
        "upper": three(some & (F.col("n_upper") * 10 > F.col("word_chars") * 3), never),
        "exclaimed": three(some & (F.col("n_exclaimed") * 5 > n), never),
        "variety": three((n >= 50) & (n < 1000) & (F.col("n_distinct_words") * 8 < n), never),
        "endings": three(some & (F.col("n_ended_lines") == 0), some & (F.col("n_ended_lines") * 2 >= F.col("n_lines"))),
    }


def logit(p: float) -> float:
    return math.log(p) - math.log1p(-p)


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[dict[int, float]]:
    """The accuracy of each rule's bad and good votes, by expectation-maximisation over vote patterns with counts.

    The latent class of a text is good or bad. E: the posterior of each pattern
    under the present accuracies; M: a vote's accuracy is the mean posterior of
    the class it votes for, over the texts with that vote, and the believed
    accuracy. An abstention is no evidence: junk of one kind does not trip the
    rules against other kinds. There are at most 3 ** rules patterns, whatever
    the number of documents.
    """
    rules = len(patterns[0][0]) if patterns else 0
    accuracy = [dict(ACCURACY) for _ in range(rules)]
    for _ in range(rounds):
        right = [dict.fromkeys(ACCURACY, 0.0) for _ in range(rules)]
        cast = [dict.fromkeys(ACCURACY, 0) for _ in range(rules)]
        for votes, count in patterns:
            p = posterior(votes, accuracy)
            for rule, vote in enumerate(votes):
                if vote:
                    right[rule][vote] += count * (p if vote == 1 else 1 - p)
                    cast[rule][vote] += count
        accuracy = [
            {v: (right[r][v] / cast[r][v] + BELIEF * a) / (1 + BELIEF) if cast[r][v] else a for v, a in ACCURACY.items()}
            for r in range(rules)
        ]
    return accuracy


def weight(vote: int, accuracy: float) -> float:
    """What a vote adds to the log-odds of good: how far its accuracy is above the class's share, if it is."""
    return vote * max(0.0, logit(accuracy) - logit(GOOD if vote == 1 else 1 - GOOD))


def posterior(votes: tuple[int, ...], accuracy: list[dict[int, float]]) -> float:
    odds = logit(GOOD) + sum(weight(v, accuracy[r][v]) for r, v in enumerate(votes) if v)
    return 1 / (1 + math.exp(-odds))


def quality_verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", cut: float = 0.5) -> DataFrame:
    """Counts, base rules and the posterior probability of good quality, a row for each row.

    base_failed: under 50 words, or over half of the words in repeated windows.
    kept: not base_failed and posterior >= ``cut``. Null and empty texts have
    zero counts and fail the base. Repeated rows get equal results, one each; an
    empty table gives no rows. Other columns of the input are not looked at.
    The counts are written once to the shared folder; the fit reads vote
    patterns with their counts, at most 3 ** 9 rows.
    """
    rules = rule_votes()
    counted = settled(text_counts(df, key, text), "rules")
    voted = counted.select("*", *(vote.alias(f"vote_{name}") for name, vote in rules.items()))
    columns = [f"vote_{name}" for name in rules]
    found: list[Row] = voted.groupBy(*columns).count().collect()
    fit = fit_votes(sorted((tuple(r[c] for c in columns), r["count"]) for r in found))
    odds = F.lit(logit(GOOD))
    for accuracy, c in zip(fit, columns, strict=False):
        odds = odds + F.when(F.col(c) == -1, weight(-1, accuracy[-1])).when(F.col(c) == 1, weight(1, accuracy[1])).otherwise(0.0)
    n = F.col("n_words")
    failed = (n < 50) | (F.col("n_repeat_words") * 100 > n * 50)
    return voted.select(
        "*",
        failed.alias("base_failed"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("posterior"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= cut))
