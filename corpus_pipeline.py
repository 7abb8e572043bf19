"""From raw documents to a training mix: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import decontamination, language_id, mixing, ngram_join, secret_scan
from ledgermill.session import shared_folder

#: SQL cannot express hash draws and learned profiles; tests check three stages on planted cases, README says what is not compared.
ORACLE_SQL = None


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns `own`, and all others by number inside the struct `row`, where no name can clash with one that a stage adds."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in own]
    return docs.select(*own, F.struct(*(others or [F.lit(True).alias("none")])).alias("row"))


def _unpacked(table: DataFrame, columns: list[str], *own: str) -> DataFrame:
    return table.select(*[F.col(c) if c in own else F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those found undetermined (null, empty, without letters) go."""
    names, table = language_id.rank_table(language_id.learn_profiles(docs.select("lang", "text")))
    found = language_id.identify(_packed(docs, "text"), names, table)
    return _unpacked(found.where(F.col("_lang_pred") != language_id.UNDETERMINED), docs.columns, "text")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of every group of near copies."""
    return ngram_join.one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars brought up to date where it counted the text."""
    rows = _packed(docs, "text", "n_chars").withColumn("_counted", F.col("n_chars") == F.char_length("text"))
    clean = secret_scan.redact(rows).withColumn(
        "n_chars", F.when(F.col("_counted"), F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return _unpacked(clean, docs.columns, "text", "n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as its source's rate says."""
    own = ("doc_id", "text", "source")
    return _unpacked(mixing.emit(mixing.mix(_packed(docs, *own))), docs.columns, *own)


STAGES = [("language_id", known_language), ("ngram_jaccard_join", distinct_texts), ("benchmark_decontamination", decontaminated),
          ("secret_scan", without_secrets), ("source_mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
