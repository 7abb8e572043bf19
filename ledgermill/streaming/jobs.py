"""Incremental jobs over arriving files and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgermill import fixed_values as V
from ledgermill.operators import boosting
from ledgermill.operators import risk_model as rm
from ledgermill.operators.extraction import items_long, parse_documents
from ledgermill.session import materialise
from ledgermill.sources.keywords import KeywordSet


#: The algorithm whose updates go on from the stored trees and read no history.
CONTINUED = "continued"


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10_000, file_format: str = "text") -> DataFrame:
    """Arriving documents: path, text. A text file is a document; a Parquet file holds many, with both columns."""
    if file_format == "parquet":
        return spark.readStream.schema("path STRING, text STRING").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return (spark.readStream.format("text").option("wholetext", True)
            .option("maxFilesPerTrigger", files_per_trigger).load(folder)
            .select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def parse_arriving_documents(spark: SparkSession, folder: str, output: str, checkpoint: str,
                             custom: KeywordSet | None = None, available_now: bool = True, files_per_trigger: int = 10_000,
                             file_format: str = "text") -> StreamingQuery:
    """Parse every arriving file once and append its items to `output`. The file source remembers what it has read, so
    a restart goes on where it stopped, and the file sink lists what each batch has written, so a replayed batch counts once."""
    documents = document_stream(spark, folder, files_per_trigger, file_format).withColumns(
        {"applicant_type": F.lit("korporat"), "file_type": F.lit("txt")})
    parsed = parse_documents(documents, custom).select(
        "nama_file", "tahun_pelaporan_terdeteksi", F.col("hasil_ekstraksi_kata_kunci").alias("items"))
    writer = items_long(parsed).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(output)


def store_model(model: rm.RiskModel | boosting.BoostedModel, root: str, version: int) -> None:
    """Save a version and then register it, so that a half-written version is never loaded."""
    model.save(f"{root}/models/v{version}")
    SparkSession.active().createDataFrame([(version,)], "version BIGINT").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/registry/v{version}")


def latest_version(spark: SparkSession, root: str, below: int | None = None) -> int:
    """The newest registered version (below a given one)."""
    versions = spark.read.schema("version BIGINT").parquet(f"{root}/registry/*")
    return (versions if below is None else versions.where(F.col("version") < below)).agg(F.max("version")).first()[0]


def latest_model(spark: SparkSession, root: str, below: int | None = None,
                 algorithm: str = "forest") -> rm.RiskModel | boosting.BoostedModel:
    """The model of that version."""
    load = boosting.BoostedModel.load if algorithm == CONTINUED else rm.RiskModel.load
    return load(f"{root}/models/v{latest_version(spark, root, below)}")


def start_model(rows: DataFrame, root: str, algorithm: str = "forest", **options) -> rm.RiskModel | boosting.BoostedModel | None:
    """First training: version 0 of the model, and its rows as the first part of the history (which continued trees do not need).
    Options go to the continued trees."""
    labelled = rm.select_features(rows, [V.TARGET])
    model = boosting.train(labelled, **options) if algorithm == CONTINUED else rm.train(labelled, algorithm)
    if model is not None:
        if algorithm != CONTINUED:
            labelled.write.mode("overwrite").parquet(f"{root}/history/batch=initial")
        store_model(model, root, 0)
    return model


def offer_batch(batch: DataFrame, batch_id: int, root: str, algorithm: str = "forest", **options) -> str:
    """Offer labelled features to the newest model below `root` that an earlier batch left, and log what came of it.

    Batch n becomes version n + 1. A replayed batch starts from the version before it and overwrites its own version, its part
    of the history and its line of the log, so it counts once.
    """
    spark = batch.sparkSession
    model = latest_model(spark, root, batch_id + 1, algorithm)
    rows = materialise(rm.select_features(batch, [V.TARGET]))
    status = rm.update_guard(rows, model)
    if status == rm.UPDATED:
        if algorithm == CONTINUED:
            updated = boosting.extend(rows, model, **options)
        else:
            history = spark.read.parquet(f"{root}/history")
            others = history.where(F.col("batch").cast("string") != str(batch_id)).drop("batch")
            updated, _ = rm.update(rows, model, others, algorithm)
            rows.write.mode("overwrite").parquet(f"{root}/history/batch={batch_id}")
        store_model(updated, root, batch_id + 1)
    rows.agg(F.lit(status).alias("status"), F.count(F.lit(1)).alias("rows"),
             F.lit(latest_version(spark, root, batch_id + 2)).cast("bigint").alias("version")).write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
    return status


def update_log(spark: SparkSession, root: str) -> DataFrame:
    """batch, status, rows, version (the newest after the batch) of every batch offered."""
    log = spark.read.schema("status STRING, rows BIGINT, version BIGINT, batch BIGINT").parquet(f"{root}/log")
    return log.select("batch", "status", "rows", "version")


def update_model_on_arrival(batches: DataFrame, root: str, checkpoint: str, algorithm: str = "forest",
                            available_now: bool = True, **options) -> StreamingQuery:
    """Offer every micro-batch of labelled features to the newest model below `root` (see `start_model`, `offer_batch`)."""
    def offer(batch: DataFrame, batch_id: int) -> None:
        offer_batch(batch, batch_id, root, algorithm, **options)

    writer = batches.writeStream.foreachBatch(offer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
