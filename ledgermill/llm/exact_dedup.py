"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks of bytes, and a chunk is hashed as a polynomial in a fixed base modulo two primes. Hashes
compose: hash(a + b) = hash(a) * base^len(b) + hash(b), so the chunks of a huge document are hashed in parallel and added
up, each shifted by the bytes behind it. Texts of equal fingerprint and length are then compared chunk by chunk: the
distinct contents of each chunk position are counted, and a fingerprint with more than one content at a position is split
into its true texts. Equal contents are merged before the shuffle, so a text with any number of copies sends one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermill.llm.sizes import broadcast_if_small
from ledgermill.session import materialise

#: The two largest primes below 2^31, and the bases.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 92821)
CHUNK = 65_536
#: Texts of more bytes are hashed in parallel, chunk by chunk.
HUGE = 32 << 20
#: The rows of a group are dealt over so many shares when its counts are brought back to them.
SHARES = 256
_PRINT = ["n_bytes", "f1", "f2"]


@lru_cache(maxsize=8)
def _powers(primes: tuple[int, int], chunk: int) -> np.ndarray:
    """Two rows of descending powers of the bases: base^(chunk - 1), ..., base, 1. A product with a byte is below 2^39, so
    the sum over a chunk fits 64 bits."""
    rows = []
    for base, prime in zip(BASES, primes):
        row = [1]
        for _ in range(chunk - 1):
            row.append(row[-1] * base % prime)
        rows.append(row[::-1])
    return np.array(rows, np.uint64)


def chunk_hash(data: np.ndarray, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK) -> tuple[int, int]:
    """Both hashes of at most `chunk` bytes."""
    sums = _powers(primes, chunk)[:, chunk - len(data):] @ data.astype(np.uint64)
    return int(sums[0]) % primes[0], int(sums[1]) % primes[1]


def compose(left: tuple[int, int], right: tuple[int, int], right_bytes: int, primes: tuple[int, int] = PRIMES) -> tuple[int, int]:
    """The hashes of a text from those of its two parts."""
    return tuple((a * pow(base, right_bytes, p) + b) % p for a, b, base, p in zip(left, right, BASES, primes))


def text_hash(data: np.ndarray, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK) -> tuple[int, int]:
    """Both hashes of a whole text."""
    out = (0, 0)
    for lo in range(0, len(data), chunk):
        part = data[lo:lo + chunk]
        out = compose(out, chunk_hash(part, primes, chunk), len(part), primes)
    return out


def shifted(value: Column, after: Column, lane: int, primes: tuple[int, int] = PRIMES) -> Column:
    """value * base^after modulo the prime of a lane, by the bits of `after`, in integer arithmetic."""
    base, prime = BASES[lane], primes[lane]
    squares = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(pow(base, 1 << k, prime)).cast("bigint").alias("v")) for k in range(40)])
    return F.aggregate(squares, value.cast("bigint"), lambda h, s: F.when(
        F.getbit(after, s["k"]) == 1, h * s["v"] % F.lit(prime)).otherwise(h))


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null as empty. Single spaces are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _bytes(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each value, without a copy."""
    for value in column:
        buffer = value.as_buffer()
        yield None if buffer is None else np.frombuffer(buffer, np.uint8)


def _hashed(rows: DataFrame, primes: tuple[int, int], chunk: int) -> DataFrame:
    """All columns of `rows` with f1, f2: the hashes of the column `body`, null where it is."""
    schema = T.StructType([*rows.schema.fields, T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType())])
    at = rows.columns.index("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None) if data is None else text_hash(data, primes, chunk) for data in _bytes(batch.column(at))]
            lanes = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lanes], names=[*batch.schema.names, "f1", "f2"])
    return rows.mapInArrow(run, schema)


def _pieces(rows: DataFrame, chunk: int) -> DataFrame:
    """One row per chunk: no, body (its bytes), after (bytes behind it), beside the other columns of `rows`."""
    at = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("n_bytes") - 1, F.lit(0)).cast("bigint"), F.lit(chunk).cast("bigint"))
    cut = rows.select("*", F.explode(at).alias("_at"))
    return cut.select(*[c for c in rows.columns if c != "body"], F.expr(f"_at div {chunk}").alias("no"),
                      F.substr(F.col("body").cast("binary"), (F.col("_at") + 1).cast("int"), F.lit(chunk)).alias("body"),
                      F.greatest(F.col("n_bytes") - F.col("_at") - chunk, F.lit(0)).alias("after"))


def composed(pieces: DataFrame, keys: list[str], primes: tuple[int, int] = PRIMES) -> DataFrame:
    """keys, n_bytes, f1, f2 of whole texts from hashes of their pieces (keys, n_bytes, no, after, f1, f2); a piece that is
    there twice counts once. Sums commute, so pieces are added in any order, in the task that hashed them first."""
    once = pieces.groupBy(*keys, "n_bytes", "no", "after").agg(F.max("f1").alias("f1"), F.max("f2").alias("f2"))
    sums = [(F.sum(shifted(F.col(f), F.col("after"), i, primes)) % F.lit(primes[i])).alias(f) for i, f in enumerate(("f1", "f2"))]
    return once.groupBy(*keys, "n_bytes").agg(*sums)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", primes: tuple[int, int] = PRIMES,
                 chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """tag (a number of the row), doc_id, sha (of the normalised text), n_bytes, f1, f2 of every row.

    Texts of more than `huge` bytes do not go to a Python worker whole: their chunks are dealt over all tasks."""
    body = normalised(F.col(text))
    size = F.octet_length(body).cast("bigint")
    sha = F.sha2(body.cast("binary"), 256)
    small = docs.select(F.col(key).alias("doc_id"), sha.alias("sha"), size.alias("n_bytes"),
                        F.when(size <= huge, body).cast("binary").alias("body"))
    rows = materialise(_hashed(small, primes, chunk).drop("body").withColumn("tag", F.monotonically_increasing_id()))
    if rows.where(F.col("f1").isNull()).limit(1).count() == 0:
        return rows
    pieces = _pieces(_bodies(docs, key, text).where(F.col("n_bytes") > huge), chunk).repartition("doc_id", "sha", "no")
    large = composed(_hashed(pieces, primes, chunk).drop("body"), ["doc_id", "sha"], primes)
    large = large.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"))
    whole = rows.join(large, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    return materialise(whole.select("tag", "doc_id", "sha", "n_bytes", F.coalesce("f1", "_f1").alias("f1"), F.coalesce("f2", "_f2").alias("f2")))


def _bodies(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = normalised(F.col(text))
    return docs.select(F.col(key).alias("doc_id"), F.sha2(body.cast("binary"), 256).alias("sha"), F.octet_length(body).cast("bigint").alias("n_bytes"),
                       body.cast("binary").alias("body"))


def suspects(docs: DataFrame, rows: DataFrame, prints: DataFrame, key: str, text: str, primes: tuple[int, int], chunk: int, huge: int) -> DataFrame:
    """doc_id, sha, n_bytes, f1, f2, no, body: the chunks of all texts with one of the given fingerprints. Texts are hashed
    again instead of being stored; huge ones have theirs from `rows`."""
    prints = broadcast_if_small(prints.select(*_PRINT))
    all_bodies = _bodies(docs, key, text)
    small = all_bodies.select("doc_id", "sha", "n_bytes", F.when(F.col("n_bytes") <= huge, F.col("body")).alias("body"))
    found = _hashed(small, primes, chunk).where(F.col("f1").isNotNull()).join(prints, _PRINT, "left_semi")
    large = rows.where(F.col("n_bytes") > huge)
    if large.limit(1).count():
        known = large.join(prints, _PRINT, "left_semi").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "f1", "f2").distinct()
        more = all_bodies.where(F.col("n_bytes") > huge).join(
            known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))).drop("_id", "_sha")
        found = found.unionByName(more)
    return _pieces(found, chunk).drop("after")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", primes: tuple[int, int] = PRIMES,
           chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of `docs`.

    Of equal texts (after white space is normalised, not trimmed) one row is kept, that of the smallest doc_id; of rows that
    repeat it, one. Null text is the empty text. A null doc_id is larger than all others; a group of such rows only has
    keep_id null. Texts of any length are compared whole. An empty table gives no rows. Only the two named columns are
    read, so extra ones may have any name.

    Fingerprints with copies are broadcast if they are at most 1,000,000, otherwise texts are joined with them by a shuffle.
    """
    rows = fingerprints(docs, key, text, primes, chunk, huge)
    repeated = rows.groupBy(*_PRINT).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    contents = suspects(docs, rows, repeated, key, text, primes, chunk, huge).select(*_PRINT, "no", "body").distinct()
    unequal = materialise(contents.groupBy(*_PRINT, "no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_PRINT).distinct())
    none = F.array().cast("array<struct<no:bigint,doc_id:bigint,sha:string>>")
    classes = rows.withColumn("variant", none)
    if unequal.limit(1).count():
        classes = rows.join(_variants(suspects(docs, rows, unequal, key, text, primes, chunk, huge)),
                            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").withColumn(
            "variant", F.coalesce("variant", none))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    dealt = classes.select("doc_id", "sha", F.struct(*_PRINT, "variant").alias("text"), first.alias("own"),
                           F.pmod(F.xxhash64("tag"), F.lit(SHARES)).alias("share"))
    shares = dealt.groupBy("text", "share").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n"))
    totals = shares.groupBy("text").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    back = shares.select("text", "share").join(totals, "text")
    return dealt.join(back, ["text", "share"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("own") == F.col("first")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def _variants(pieces: DataFrame) -> DataFrame:
    """_id, _sha, variant: for texts whose fingerprint is that of another text, the first document with the same content at
    each chunk. Two texts are equal exactly if these lists are."""
    named = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("sha").alias("sha"))
    at = [*_PRINT, "no", "body"]
    first = pieces.groupBy(*at).agg(F.min(named).alias("first"))
    marked = pieces.join(first, at).select("doc_id", "sha", F.struct("no", "first.doc_id", "first.sha").alias("mark")).distinct()
    return marked.groupBy(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).agg(F.array_sort(F.collect_list("mark")).alias("variant"))


def unique(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, whatever their names; of rows that repeat a kept doc_id and its
    text, one."""
    kept = groups(docs, key, text).where("kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("s")).distinct()
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    own = row.select("row", F.col("row")[key].alias("id"), F.sha2(normalised(F.col("row")[text]).cast("binary"), 256).alias("sha"))
    once = own.join(kept, F.col("id").eqNullSafe(F.col("k")) & (F.col("sha") == F.col("s")), "left_semi").dropDuplicates(["id", "sha"])
    return once.select("row.*")
