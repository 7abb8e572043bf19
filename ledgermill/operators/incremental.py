"""Incremental processing of inputs, purging of old results and deterministic splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions.text import content_key


def with_input_key(files: DataFrame, method: str | None = None) -> DataFrame:
    """Add `key`: SHA-256 of path, modification time and method."""
    parts = [F.col("path"), F.col("modificationTime").cast("string")]
    if method is not None:
        parts.append(F.lit(method))
    return files.withColumn("key", content_key(*parts))


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose key has no stored result: new or changed ones."""
    return files.join(done.select("key"), "key", "left_anti")


def incremental_results(files: DataFrame, done: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored results of unchanged inputs together with fresh results of the others.

    `process` maps pending inputs to rows with the columns of `done`."""
    hits = done.join(files.select("key"), "key", "left_semi")
    return hits.select(*done.columns).unionByName(process(pending(files, done)).select(*done.columns))


def purge(results: DataFrame, stamp: str = "stored_at", now: Column | None = None,
          max_age_seconds: int = V.CACHE_SECONDS) -> DataFrame:
    """Results that are at most `max_age_seconds` old; strictly older ones go."""
    now = F.current_timestamp() if now is None else now
    return results.where(F.unix_micros(now) - F.unix_micros(F.col(stamp)) <= max_age_seconds * 1_000_000)


def pick_hash(key: str | Column, seed: int = 42) -> Column:
    """A hash in hexadecimal digits that any engine has: MD5 of the seed, a colon and the key as text (null as empty)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def hash_split(table: DataFrame, key: str, percent: int = 70, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two complementary parts by the first seven digits of the key's hash; no shuffle and no sampling state."""
    inside = F.conv(F.substring(pick_hash(key, seed), 1, 7), 16, 10).cast("bigint") % 100 < percent
    return table.where(inside), table.where(~inside)


def one_per_group(table: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """One pseudo-random row per group, the one of the least hash. A minimum is aggregated map-side, so a large group is never sorted."""
    row = F.struct(*table.columns)
    picked = table.groupBy(group).agg(F.min_by(row, F.struct(pick_hash(key, seed), F.col(key))).alias("row"))
    return picked.select("row.*")


def first_record(records: DataFrame, name: str, order: Sequence[str] = ("source", "pos")) -> DataFrame:
    """First record of a file name in source order."""
    hits = records.where(F.col("nama_file") == name)
    return (hits.groupBy("nama_file").agg(F.min_by("hasil_ekstraksi", F.struct(*order)).alias("hasil_ekstraksi"))
            .select("nama_file", "hasil_ekstraksi"))


def first_records(records: DataFrame, order: Sequence[str] = ("source", "pos")) -> DataFrame:
    """First record of every file name in source order, and how many there are."""
    return records.groupBy("nama_file").agg(F.min_by("hasil_ekstraksi", F.struct(*order)).alias("hasil_ekstraksi"), F.count(F.lit(1)).alias("records"))
