"""Benchmark decontamination: MinHash containment search, size-partitioned, in native expressions only.

A test item is found in a document if the document holds at least 80 % of the item's distinct five-word shingles. Of every
item the k smallest shingle hashes (a bottom-k MinHash sketch) are indexed. Items are partitioned by size, and k follows from
the upper size u of the partition: an item may miss at most 20 % of its shingles, so one of floor(u / 5) + 1 of them is always
in the document, however long that is. Documents therefore look up all their shingle hashes, unsampled, in a small index; no
match can be missed. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.sizes import broadcast_if_small

SHINGLE, PERCENT = 5, 80
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Letters and digits in lower case, so that punctuation, case and white space do not hide a passage. Null: none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _windows(count: Column) -> Column:
    """Starts of the shingles: one for a text of one to four words, none without words."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - SHINGLE, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def with_shingle_hashes(texts: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and `_h`, the hashes of the shingles of `text` by position. Absent words of a short text count as
    null. Words and their hashes are columns of their own, so that each is computed once per row."""
    split = texts.select(*keep, words(F.col("text")).alias("_w"))
    hashed = split.select(*keep, F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_wh"))
    return hashed.select(*keep, F.transform(_windows(F.col("_n")), lambda i: F.xxhash64(
        F.least(F.col("_n"), F.lit(SHINGLE)), *[F.get(F.col("_wh"), i + j) for j in range(SHINGLE)])).alias("_h"))


def shingle_texts(word_array: Column, count: Column) -> Column:
    """Distinct shingles as text."""
    return F.array_distinct(F.transform(_windows(count), lambda i: F.array_join(F.slice(word_array, i + 1, SHINGLE), " ")))


def sketch_index(benchmark: DataFrame) -> DataFrame:
    """item_id, partition, hash: the k smallest distinct shingle hashes of each item."""
    hashed = with_shingle_hashes(benchmark, "item_id").select("item_id", F.array_sort(F.array_distinct("_h")).alias("_h"))
    sized = hashed.where(F.size("_h") > 0).withColumn("partition", F.ceil(F.log2(F.size("_h").cast("double"))).cast("int"))
    upper = F.pow(F.lit(2.0), F.col("partition"))
    k = (F.floor(upper * (100 - PERCENT) / 100) + 1).cast("int")
    return sized.select("item_id", "partition", F.explode_outer(F.slice("_h", 1, F.least(k, F.size("_h")))).alias("hash"))


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment: every item of which a document holds 80 % of the shingles.

    Items and documents without words match nothing. An item of fewer than five words is one shingle and matches only a
    document of the same words. A passage that many documents hold gives one row per document; nothing is grouped by
    passage. Rows that repeat a doc_id are one document here if their texts agree and are verified each if not. Null ids
    take part as ids. Extra columns are not read; empty tables give an empty result.
    """
    slim = docs.select(F.col("doc_id").alias("doc_id"), "text")
    index = broadcast_if_small(sketch_index(benchmark.select("item_id", "text")).select("item_id", "hash"))
    # explode_outer: for explode Spark would filter on the size of the array first and compute it a second time for that
    hashes = with_shingle_hashes(slim, "doc_id").select("doc_id", F.explode_outer("_h").alias("hash"))
    candidates = broadcast_if_small(hashes.join(index, "hash").select("doc_id", "item_id").distinct())
    items = benchmark.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("_iw")).select(
        "_item", shingle_texts(F.col("_iw"), F.size("_iw")).alias("_is"))
    asked = candidates.select(F.col("doc_id").alias("_doc"), "item_id")
    pairs = slim.join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")))
    split = pairs.select("doc_id", "item_id", words(F.col("text")).alias("_w"))
    both = split.select("doc_id", "item_id", shingle_texts(F.col("_w"), F.size("_w")).alias("_ds")).join(
        items, F.col("item_id").eqNullSafe(F.col("_item")))
    found = both.select("doc_id", "item_id", F.size("_is").cast("bigint").alias("n_shingles"),
                        F.size(F.array_intersect("_is", "_ds")).cast("bigint").alias("n_found"))
    return (found.where((F.col("n_shingles") > 0) & (F.col("n_found") * 100 >= F.col("n_shingles") * PERCENT)).distinct()
            .withColumn("containment", F.col("n_found") / F.col("n_shingles")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no test item was found."""
    hits = broadcast_if_small(contained_items(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_anti")
