"""The corpus pipeline: documents in, packed pieces of the documents worth training on out."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.ngram_join import near_duplicates
from engram.llm.packing import pack
from engram.llm.quality_model import quality_scores
from engram.llm.toxicity import toxicity_scores
from engram.sources.shared import settled, shared_folder

# The fits and the packing plan have no form in SQL; tests hold run() against a plain program.
ORACLE_SQL = None


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not take for toxic."""
    return toxicity_scores(docs, labels(spark, sf_dir)).where(~F.col("is_toxic")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: a score under one half speaks against a document."""
    return quality_scores(docs, labels(spark, sf_dir)).where(F.col("score") >= 0.5).select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id; repeated rows of it once."""
    found = settled(near_duplicates(docs), "groups")
    dropped = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    twice = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(once.select(*docs.columns)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, each with its sequence and place there."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
