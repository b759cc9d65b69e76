"""The corpus pipeline: language ID, quality classifier, n-gram Jaccard join, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents: rows that are rejected go, and mixing repeats or
leaves out rows as their rates say. Null ids and texts, empty tables and further columns are handled as the operators'
docstrings say; a document without a letter, or whose words fit no learned language, is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import jaccard, language, mixing, packing, quality
from bindery.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; learned from the labelled documents that are not held out.

    A text of several learned languages is kept whichever of them leads; one whose words fit none of them is rejected.
    """
    learned = language.learned_from(docs)
    model = language.train(learned)
    return language.keep(docs, model, 0.0, language.floors(learned, model))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.keep(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by the rates that bring the languages' token totals to their targets."""
    return mixing.resample(docs, docs.select("doc_id", F.col("lang").alias("label")))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing_weights", mixing_weights),
    ("best_fit", best_fit),
]

#: SQL can express neither the trained models nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name, few=True)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
