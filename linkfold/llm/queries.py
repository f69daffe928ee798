"""The registered queries of the corpus operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkfold.llm import language_id, mixing, ngram_join, packing, quality_classifier, quality_rules, search, sharding, token_orc, url_filter
from linkfold.llm.common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(packing.pack(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "copies", "class_id", "links")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.shard_documents(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    rows = store.read().withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))
    return rows.select("doc_id", "lang", "source", "n_chars", "text_crc32", F.col(store.file_column).alias("shard_file"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_orc.ids_digest(token_orc.read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, its whole text being the query."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where(F.col("doc_id") % 100 == 0), 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_packing, op3_quality_rules, op4_quality_classifier, op5_ngram_join, op6_sharding, op7_token_orc, op8_url_filter, op9_mixing, op10_search)}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": url_filter.oracle()}
