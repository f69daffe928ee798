"""The corpus pipeline: quality classifier, language ID, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of docs; the last returns
packed sequences in pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkfold.llm import language_id, mixing, ngram_join, packing, quality_classifier
from linkfold.llm.common import materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among docs."""
    model = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language."""
    return language_id.keep_known(docs, language_id.learn(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, each at least once."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", good_documents),
    ("language_id", known_language),
    ("ngram_join", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: Models, shingles and token ids are beyond SQL; tests/llm/test_pipeline.py holds the rows against each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
