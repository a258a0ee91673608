"""Pluggable model hooks: tokenizer, embedder, summarizer.

Each hook is a function from a text Column to a Column. The defaults need no model;
``tokenizer_hook``, ``embedder_hook`` and ``summarizer_hook`` turn a
function over pandas Series into a hook, called on Arrow batches.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import compress_text, estimate_tokens
from engram.functions.vectors import hashed_embedding

Hook = Callable[[Column], Column]

default_tokenizer: Hook = estimate_tokens
default_embedder: Hook = hashed_embedding
default_summarizer: Hook = compress_text


def tokenizer_hook(count: Callable[[pd.Series], pd.Series]) -> Hook:
    def batches(texts: pd.Series) -> pd.Series:
        return count(texts.fillna("")).where(texts.notna()).astype("Int32")

    return F.pandas_udf(batches, "int")


def _model_hook(load: Callable[[], Callable[[pd.Series], pd.Series]], returns: str, batch_size: int) -> Hook:
    """One ``load()`` per Python worker task, calls of at most ``batch_size`` texts.

    A batch that raises is tried again text by text, and a text that raises
    alone becomes null, so one bad row costs only itself. Spark may not work a
    call out a second time where its result is used more than once.
    """

    def one(model, text):
        try:
            return model(pd.Series([text])).iloc[0]
        except Exception:
            return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            places = [i for i, there in enumerate(texts.notna()) if there]
            out: list = [None] * len(texts)
            for start in range(0, len(places), batch_size):
                part = texts.iloc[places[start : start + batch_size]]
                try:
                    results = list(model(part))
                except Exception:
                    results = [one(model, text) for text in part]
                for place, value in zip(places[start : start + batch_size], results):
                    out[place] = value
            yield pd.Series(out, index=texts.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returns).asNondeterministic()


def embedder_hook(load: Callable[[], Callable[[pd.Series], pd.Series]], batch_size: int = 32) -> Hook:
    return _model_hook(load, "array<float>", batch_size)


def summarizer_hook(load: Callable[[], Callable[[pd.Series], pd.Series]], batch_size: int = 32) -> Hook:
    return _model_hook(load, "string", batch_size)


def embed_text(spark: SparkSession, text: str, embedder: Hook = default_embedder) -> list[float]:
    """The vector of one query text."""
    row = spark.range(1).select(embedder(F.lit(text)).alias("v")).first()
    return [float(x) for x in row["v"]]


def embed_new_texts(
    df: DataFrame, text: str, embedder: Hook = default_embedder, known: DataFrame | None = None
) -> DataFrame:
    """Vectors of the distinct texts not yet known, as (text_hash, embedding).

    Known texts leave before anything is merged. Copies are merged before the
    shuffle, so a text held by many rows is embedded once.
    """
    hashed = df.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("text_hash"), F.col(text).alias("text"))
    if known is not None:
        hashed = hashed.join(known.select("text_hash").distinct(), "text_hash", "left_anti")
    distinct = hashed.groupBy("text_hash").agg(F.first("text").alias("text"))
    return distinct.select("text_hash", embedder(F.col("text")).alias("embedding"))
