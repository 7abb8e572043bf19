"""Token counts of documents that lie one after another in flat token files without an index.

A file is a run of token ids in which an end-of-document id closes every document. It is cut into blocks of equal length.
Each block is searched for the id in one vectorised comparison, whatever its neighbours hold. Documents that cross blocks
are put together afterwards: running sums over the block summaries (one small row per block) say how many tokens and ends
lie before a block and where the last end before it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ledgermill.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 65_536
#: Split rule of the byte-level vocabulary; a fixed value that belongs to the tokenizer file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_SCHEMA = "file long, block long, data binary, ids binary"
SUMMARY_SCHEMA = "file long, block long, n_tokens long, ends array<long>, doc_ids array<long>"
_encoders: dict = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a file of ranks, loaded once per Python worker."""
    if path not in _encoders:
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode(text: str | None, path: str = TOKENIZER) -> list[int]:
    """Ids of a text; unpaired surrogates cannot occur in Spark strings. Null: none."""
    return encoder(path).encode_ordinary(text) if text else []


def flat_blocks(docs: DataFrame, path: str = TOKENIZER, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data, ids): the documents of each input split as one flat file of little-endian uint16 ids in blocks.

    `ids` of a block are the ids of the documents whose first token (or end) lies in it; the separator scan never reads
    them, they only name the results. At most one block and one text are held at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block = TaskContext.get().partitionId(), 0
        held, n_held, names = [], 0, []

        def row(data: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()),
                "data": pa.array([data.astype("<u2").tobytes()], pa.binary()),
                "ids": pa.array([np.array(names, "<i8").tobytes()], pa.binary())})
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.append(np.array([*encode(text.as_py(), path), end], np.int64))
                n_held += len(held[-1])
                names.append(-1 if doc_id.as_py() is None else doc_id.as_py())
                while n_held >= block_tokens:
                    flat = np.concatenate(held)
                    yield row(flat[:block_tokens])
                    held, n_held, names, block = [flat[block_tokens:]], n_held - block_tokens, [], block + 1
        if n_held or names:
            yield row(np.concatenate(held))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK_SCHEMA)


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data, ids) of binary shards of uint16 ids, by any path that Spark reads. A shard is one row of the
    reader (2 GB at most), cut into blocks by native expressions; `ids` is empty."""
    size = 2 * block_tokens
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))
    return (files.select(F.xxhash64("path").alias("file"), "content", F.explode(starts).alias("block"))
            .select("file", "block", F.substring(F.col("content"), (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data"),
                    F.lit(b"").alias("ids")))


def scan_blocks(blocks: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, block, n_tokens, ends, doc_ids): positions of the end-of-document id in each block, by one comparison."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(x.as_py() or b"", "<u2") for x in batch.column(2)]
            yield pa.RecordBatch.from_pydict({
                "file": batch.column(0), "block": batch.column(1),
                "n_tokens": pa.array([len(x) for x in data], pa.int64()),
                "ends": pa.array([np.flatnonzero(x == end) for x in data], pa.list_(pa.int64())),
                "doc_ids": pa.array([np.frombuffer(x.as_py() or b"", "<i8") for x in batch.column(3)], pa.list_(pa.int64()))})
    return blocks.mapInArrow(run, SUMMARY_SCHEMA)


def document_lengths(summaries: DataFrame) -> DataFrame:
    """(file, doc_index, first_token, n_tokens) of every document, the end id not counted.

    The prefix scan runs over scalars only, one row per block. Tokens after the last end of a file are a last, unclosed
    document. Two ends in a row enclose a document of 0 tokens.
    """
    scalars = summaries.select("file", "block", "n_tokens", F.size("ends").alias("_n"), F.element_at("ends", -1).alias("_last")) \
        if summaries.sparkSession.conf.get("spark.sql.ansi.enabled") == "false" else \
        summaries.select("file", "block", "n_tokens", F.size("ends").alias("_n"), F.try_element_at("ends", F.lit(-1)).alias("_last"))
    order = W.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    placed = scalars.withColumn("_offset", offset).select(
        "file", "block", "_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_docs"),
        F.coalesce(F.last(F.col("_offset") + F.col("_last"), ignorenulls=True).over(earlier), F.lit(-1)).alias("_before"),
        F.lead("block").over(order).isNull().alias("_final"))
    each = summaries.join(placed, ["file", "block"])
    ends = F.transform("ends", lambda e: e + F.col("_offset"))
    stop = F.col("_offset") + F.col("n_tokens")
    last = F.when(F.size("ends") > 0, F.element_at(ends, F.greatest(F.size("ends"), F.lit(1)))).otherwise(F.col("_before"))
    closed = F.when(F.col("_final") & (last < stop - 1), F.concat(ends, F.array(stop))).otherwise(ends)
    found = each.select("file", "_docs", "_before", closed.alias("_ends"))
    return (found.select("file", "_docs", "_before", "_ends", F.posexplode("_ends").alias("_i", "_end"))
            .withColumn("_start", F.when(F.col("_i") == 0, F.col("_before")).otherwise(
                F.get("_ends", F.greatest(F.col("_i") - 1, F.lit(0)))) + 1)
            .select("file", (F.col("_docs") + F.col("_i")).alias("doc_index"), F.col("_start").alias("first_token"),
                    (F.col("_end") - F.col("_start")).alias("n_tokens")))


def token_counts(docs: DataFrame, path: str = TOKENIZER, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, file, doc_index, n_tokens of all documents, counted by the separator scan over their flat token files.

    A null or empty text is a document of 0 tokens; a null doc_id comes back as -1; repeated rows are counted each.
    Extra columns are not read. An empty table gives an empty result.
    """
    summaries = materialise(scan_blocks(flat_blocks(docs, path, end, block_tokens), end))
    names = summaries.select("file", "block", F.posexplode("doc_ids").alias("_i", "doc_id"))
    counts = summaries.select("file", "block", F.size("doc_ids").alias("_n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("file", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    named = names.join(first, ["file", "block"]).select("file", (F.col("_first") + F.col("_i")).alias("doc_index"), "doc_id")
    return named.join(document_lengths(summaries), ["file", "doc_index"]).select("doc_id", "file", "doc_index", "n_tokens")
