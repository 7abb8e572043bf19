"""Filter interaction audit by incremental retraction streaming.

Every document gets a mask with one bit per filter it fails. Four bits depend on its text alone; the fifth says whether a
document of smaller id has the same text, which is only known once all files have been seen. All files are read as
available-now micro-batches. State keyed by the text keeps the least id so far and the counter rows it stands for: when a
smaller id arrives, the earlier mask is taken back from the counters (a negative row) and counted again with the duplicate
bit. State and counters are Parquet tables with a part per batch; a replayed batch reads the parts before its own and
replaces its own. Everything asked about orders of filters is then a sum over masks, of which a part has at most 32.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ledgermill.llm.sizes import broadcast_if_small
from ledgermill.session import materialise, shared_folder

FILTERS = "ABCDE"
DUPLICATE = 16
SPACE = r"[\x20\x09-\x0D]+"
#: The files are read in about so many micro-batches, whatever their number, so the state is read as many times.
MICRO_BATCHES = 4
_ROW = "key binary, doc_id bigint, settled boolean, part string, mask int, flags int, n bigint"
_COUNTER = "part string, mask int, flags int, n bigint"
_STATE = "key binary, doc_id bigint, part string, mask int, flags int, n bigint"


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4, 8 of the filters A to D on a text that is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
             100 * capitals.cast("bigint") > 10 * F.char_length(text).cast("bigint"), F.rlike(text, F.lit("[#$%&*|]"))]
    return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key (digest of the text), doc_id, part, mask, flags (1: good, 2: toxic) of every row of `docs`; the text stops here.

    A document is good or toxic if any of its label rows says so. Labels of at most 1,000,000 documents are broadcast."""
    def says(name: str, value: int) -> Column:
        return F.max(F.when(F.col(name) == 1, value).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("_labelled")).agg(
        (says("quality", 1) + says("toxic", 2)).alias("_flags"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.sha2(text.cast("binary"), 256).alias("hex"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"))
    return rows.join(broadcast_if_small(known), F.col("doc_id") == F.col("_labelled"), "left").select(
        F.unhex("hex").alias("key"), "doc_id", "part", "mask", F.coalesce("_flags", F.lit(0)).alias("flags"))


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts equal rows of a batch before the shuffle. A row above the least id of its text in this batch is settled: it
    fails as a duplicate whatever comes, so it gives up the key of its text. A frequent text thus sends a row or two per
    batch. Rows without an id are settled as well: none is smaller than they, and they are smaller than none."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        known = pc.is_valid(batch["doc_id"]).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch["doc_id"], 0).to_numpy(zero_copy_only=False)
        texts = batch["key"].dictionary_encode()
        code = texts.indices.to_numpy(zero_copy_only=False)
        least = np.full(len(texts.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(least, code[known], ids[known])
        above = known & (ids > least[code])
        settled = above | ~known
        table = pa.table({
            "key": pc.if_else(pa.array(settled), pa.scalar(b"", batch["key"].type), batch["key"]), "doc_id": np.where(settled, 0, ids), "settled": settled,
            "part": batch["part"], "mask": batch["mask"].to_numpy() + DUPLICATE * above.astype(np.int32), "flags": batch["flags"],
            "n": np.ones(len(ids), np.int64)})
        names = ["key", "doc_id", "settled", "part", "mask", "flags"]
        yield from table.group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"]).to_batches()


def revise(arrived: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of a micro-batch and of the state with `least` (least id of the text now) and `before` (until now, from the state).

    The state has a row per part and label of every id that was the least of its text once; only the last one counts."""
    both = arrived.withColumn("old", F.lit(False)).unionByName(state.withColumn("old", F.lit(True)))
    text = W.partitionBy("key")         # arrived rows of a text: one or two per Arrow batch
    return both.withColumns({"least": F.min("doc_id").over(text), "before": F.min(F.when(F.col("old"), F.col("doc_id"))).over(text)})


def counter_changes(revised: DataFrame) -> DataFrame:
    """part, mask, flags, n: arrived rows are counted, and rows of an id that is no longer the least are taken back and counted
    as duplicates."""
    def entry(mask: Column, n: Column) -> Column:
        return F.struct("part", mask.alias("mask"), "flags", n.alias("n"))
    mask, n, later = F.col("mask"), F.col("n"), F.col("doc_id") > F.col("least")
    taken_back = F.array(entry(mask, -n), entry(mask.bitwiseOR(DUPLICATE), n))
    return revised.select(F.inline(
        F.when(~F.col("old"), F.array(entry(F.when(later, mask.bitwiseOR(DUPLICATE)).otherwise(mask), n)))
        .when(later & (F.col("doc_id") == F.col("before")), taken_back)))


def document_stream(spark: SparkSession, path: str, batches: int = MICRO_BATCHES) -> DataFrame:
    """All files of a Parquet table as a stream of about `batches` micro-batches."""
    table = spark.read.parquet(path)
    files = max(1, math.ceil(len(table.inputFiles()) / batches))
    # as a pattern, the path may also be a single file
    return (spark.readStream.schema(table.select("doc_id", "text", "lang").schema).option("maxFilesPerTrigger", files)
            .parquet(f"{path[:-1]}[{path[-1]}]"))


def count_masks(stream: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """part, mask, flags, n after all files that the stream has now. Called again on the same folder it goes on: only files
    that came since are read, and the state of earlier ones is revised."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = materialise(batch)                       # counted rows without texts, read several times
        own = rows.sparkSession
        state = (own.read.schema(f"{_STATE}, batch bigint").parquet(f"{folder}/state").where(F.col("batch") < batch_id).drop("batch")
                 if batch_id else own.createDataFrame([], _STATE))
        revised = materialise(revise(rows.where(~F.col("settled")).drop("settled"), state))
        changes = rows.where("settled").select("part", "mask", "flags", "n").unionByName(counter_changes(revised))
        changes.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/counters/batch={batch_id}")
        revised.where(~F.col("old") & (F.col("doc_id") == F.col("least"))).drop("old", "least", "before").write.mode("overwrite").parquet(
            f"{folder}/state/batch={batch_id}")
    query = (masked(stream, labels).mapInArrow(combine, _ROW).writeStream.foreachBatch(keep)
             .option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start())
    query.awaitTermination()
    counters = spark.read.schema(_COUNTER).parquet(f"{folder}/counters")
    return counters.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n"))


def report(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders.

    What a filter does at a step depends only on the set of filters before it, so the counts are summed for 5 x 16 pairs
    of filter and set, and each is then written for the orders that it stands in. A document that fails k filters is
    removed by each of them in 120 / k orders."""
    places: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            places.setdefault((1 << f, sum(1 << g for g in order[:step])), []).append(("".join(FILTERS[g] for g in order), step + 1))
    pairs = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in places])
    where = F.create_map(*[x for (bit, before), at in places.items() for x in (
        F.lit(32 * bit + before), F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in at]))])
    mask, bit, before, n = F.col("mask"), F.col("bit"), F.col("before"), F.col("n")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(condition: Column, value: Column = n) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("bigint")
    orders = math.factorial(len(FILTERS))
    share = F.get(F.array(F.lit(0), *[F.lit(orders // k) for k in range(1, len(FILTERS) + 1)]), F.bit_count(mask))
    sums = counts.select("part", "mask", "flags", "n", F.inline(pairs)).groupBy("part", "bit", "before").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"), total(fails & ~gone & (F.col("flags").bitwiseAND(1) != 0)).alias("good_lost"),
        total(fails & ~gone & (F.col("flags").bitwiseAND(2) != 0)).alias("toxic_lost"), total(fails, n * share).alias("shapley"))
    return sums.select("part", F.inline(F.element_at(where, 32 * bit + before)), "kept", "removed", "redundant", "unique_fails",
                       "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = MICRO_BATCHES, folder: str | None = None) -> DataFrame:
    """The report over all documents of a Parquet table (doc_id, text, lang; further columns are not read).

    Null text counts as empty, and empty texts are copies of each other; null lang is the part of the empty string, as is
    lang ''. A null doc_id is never a duplicate nor the original of one. Rows that repeat the least doc_id of a text are
    not duplicates, as none is smaller. Ties of modification time between files change nothing: any order of arrival gives
    the same sums. An empty table gives no rows. Texts of any length are read whole, in the JVM, and only their digest
    travels. Extra columns, of any name, are ignored.
    """
    folder = folder or f"{shared_folder(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    return report(count_masks(document_stream(spark, path, batches), labels, folder))
