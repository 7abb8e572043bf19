"""Registered queries of the training-data operators; each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import (chat_format, decontamination, exact_dedup, filter_audit, heap_clusters, html_templates, language_id,
                            mixing, ngram_join, secret_scan, token_counts, url_filter, vector_search)
from ledgermill.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_read(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(_read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.search(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_trap(_read(spark, sf_dir, "conversations")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.main_texts(_read(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_read(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_clusters.cluster(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_token_counts, op3_language_id, op4_ngram_jaccard_join, op5_benchmark_decontamination,
    op6_nearest_neighbours, op7_url_filter, op8_chat_format, op9_html_extraction, op10_secret_scan,
    op11_centroid_clusters, op12_exact_dedup, op13_filter_audit)}
