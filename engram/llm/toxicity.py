"""Toxicity by a chain of linear classifiers over the words that mark toxic texts."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from engram.llm.common import settled, small_batches
from engram.llm.linear import fit_chain, run_chain

CATEGORIES = ("marked", "repeated", "toxic")
SAMPLE_ROWS = 20_000
CANDIDATES = 20_000
TERMS = 192
FOLDS = 5
KNOWN = 100_000
BEGINNINGS = (4, 5, 6)
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*#$%&|¡¿"


def forms(word: str) -> list[str]:
    """A word's features: the word itself and its beginnings, which stand for its stem."""
    bare = word.strip(EDGES)
    return [bare, *(f"{bare[:n]}-" for n in BEGINNINGS if len(bare) > n)] if bare else []


def text_forms(text: str | None) -> set[str]:
    return {f for w in set((text or "").lower().split()) for f in forms(w)}


def counted_forms(df: DataFrame, text: str, among: frozenset[str] | None) -> DataFrame:
    """form, n: texts with the form, added up per task before they are shuffled, ``KNOWN`` forms at a time."""

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        names = list(counts)
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[f] for f in part], pa.int64())], names=["form", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column(0):
                found = text_forms(body.as_py())
                counts.update(found if among is None else found & among)
                if len(counts) > KNOWN:
                    yield from rows(counts)
                    counts.clear()
        yield from rows(counts)

    return df.select(text).mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def chosen_terms(rows: DataFrame, text: str, label: str, candidates: int, terms: int) -> list[str]:
    """The forms that speak most clearly for toxic texts, by the difference of their shares in standard errors."""
    toxic, other = rows.where(F.col(label) == 1), rows.where(F.col(label) == 0)
    n_toxic, n_other = toxic.count(), other.count()
    least = max(3, n_toxic // 100)
    seen = counted_forms(toxic, text, None).where(F.col("n") >= least)
    found = {r["form"]: r["n"] for r in seen.orderBy(F.desc("n"), "form").limit(candidates).collect()}
    if not found:
        return []
    outside = {r["form"]: r["n"] for r in counted_forms(other, text, frozenset(found)).collect()}
    scored = []
    for form, n in found.items():
        m = outside.get(form, 0)
        p, q = n / n_toxic, m / max(n_other, 1)
        all_share = (n + m) / (n_toxic + n_other)
        error = max((all_share * (1 - all_share) * (1 / n_toxic + 1 / max(n_other, 1))) ** 0.5, 1e-9)
        if p > 5 * q and n > m and p - q > 4 * error:
            scored.append((-(p - q) / error, form))
    return [form for _, form in sorted(scored)[:terms]]


class TermReader:
    """Which of the terms a text has, and how many of its words have one."""

    def __init__(self, terms: list[str], known: int = KNOWN):
        self.place = {t: i for i, t in enumerate(terms)}
        # All forms of a word begin as it does: of words that begin like a term places are kept, the others have none.
        self.heads = {t[: BEGINNINGS[0]] for t in terms}
        self.words: dict[str, tuple[int, ...]] = {}
        self.known = known

    def row(self, text: str | None) -> np.ndarray:
        words, x, hits = self.words, np.zeros(len(self.place) + 2), 0
        if len(words) > self.known:
            words.clear()
        for w, n in Counter((text or "").lower().split()).items():
            if w.strip(EDGES)[: BEGINNINGS[0]] not in self.heads:
                continue
            places = words.get(w)
            if places is None:
                places = words[w] = tuple(self.place[f] for f in forms(w) if f in self.place)
            if places:
                hits += n
                x[list(places)] = 1.0
        x[-2], x[-1] = np.log1p(hits), float(hits > 0)
        return x


def toxicity_scores(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    cut: float = 0.5,
) -> DataFrame:
    """All columns of ``df`` and p_marked, p_repeated, p_toxic and is_toxic of each row's whole text.

    The chain has three categories of the labelled toxic texts: marked (a term
    that speaks for toxic texts occurs), repeated (three words with such terms
    or more) and toxic, the label itself. At most ``sample_rows`` labelled rows
    are learnt from, chosen by a hash of the key; every row is scored. A null
    text is scored as the empty one. Rows with a null label are not learnt from,
    of repeated labels of a key the highest counts. Without toxic labels
    no text is toxic. Repeated rows are scored
    each; columns of ``df`` with the new names are replaced; an empty table
    gives no rows.
    """
    new = [f"p_{c}" for c in CATEGORIES]
    df = df.drop(*new, "is_toxic")
    marks = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(key).alias("marked_key")).agg(F.max(toxic).alias("mark"))
    marks = marks.orderBy(F.xxhash64("marked_key"), "marked_key").limit(sample_rows)
    learnt = df.select(F.col(key).alias("marked_key"), F.col(text).alias("body")).join(F.broadcast(marks), "marked_key")
    # Of repeated keys one text, so that the bound holds for rows too.
    rows = settled(learnt.groupBy("marked_key").agg(F.min("body").alias("body"), F.max("mark").alias("mark")), "toxicity")
    with small_batches(df.sparkSession):
        terms = chosen_terms(rows, "body", "mark", CANDIDATES, TERMS)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(terms)
        for batch in batches:
            x = [np.r_[np.flatnonzero(v[:-2]), -1.0, v[-2], v[-1]] for v in map(reader.row, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "mark", "fold"])

    fold = F.pmod(F.xxhash64("marked_key", F.lit("fold")), F.lit(FOLDS)).cast("long").alias("fold")
    with small_batches(df.sparkSession):
        found = rows.select("body", F.col("mark").cast("long").alias("mark"), fold).mapInArrow(design, "x array<double>, mark long, fold long").collect()
    x = np.zeros((len(found), len(terms) + 2))
    for i, r in enumerate(found):
        x[i, [int(p) for p in r["x"][:-3]]] = 1.0
        x[i, -2:] = r["x"][-2:]
    mark = np.array([r["mark"] for r in found], float)
    y = np.stack([mark * (x[:, -1] > 0), mark * (x[:, -2] >= np.log1p(3)), mark], axis=1)
    models = fit_chain(x, y, np.array([r["fold"] for r in found], int), FOLDS)
    if not mark.any():
        for w in models:
            w[:], w[-1] = 0.0, -40.0

    reader = TermReader(terms)

    def chances(body: str | None) -> list[float]:
        return run_chain(reader.row(body)[None, :], models)[0].tolist()

    # Python gets the text alone, a hundred rows at a time: the caller runs this, and by Arrow a task held
    # thousands of whole rows several times over. As a function that isn't deterministic it runs once a row.
    scored = df.withColumn(new[0], F.udf(chances, ArrayType(DoubleType()), useArrow=False).asNondeterministic()(F.col(text)))
    scored = scored.withColumns({name: F.col(new[0])[c] for c, name in enumerate(new)})
    return scored.withColumn("is_toxic", F.col("p_toxic") >= cut)
