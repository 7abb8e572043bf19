"""Mixing sources to target weights.

Sizes are summed per source, every source gets a target and with it a repetition rate = target / size, and each document is
taken floor(rate) times plus one more time with probability equal to the fraction. The extra copy is a Bernoulli draw
from a hash of the document id and a seed, so a rerun on any cluster takes the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgermill.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3.0
#: Source tables of at most so many rows are broadcast to the documents; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_rates(sized: DataFrame, most_repeats: float = MOST_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size).

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes. A target stops at
    most_repeats times the size of its source, and what is left over is shared by weight among the others until none is
    above. That is a common level: target = min(limit, level * weight). In ascending order of limit / weight, the sources
    before the level are at their limit, so two running sums give it without a loop. The windows see one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    # one row per source, after aggregation
    ranked = sums.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]),
                                                            F.pmod(F.col("_n") - 1, F.lit(len(weights)))).alias("_w"), "_n")
    limit = F.col("source_size") * F.lit(float(most_repeats))
    order = W.orderBy(limit / F.col("_w"), "_n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = weighted.withColumns({
        "_level": (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("_w").over(after)})
    # a source is free if its own limit is above the level that the sources from it onwards would share
    free = F.when(limit >= F.col("_level") * F.col("_w"), F.col("_level"))
    first_free = F.first(free, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(limit, F.coalesce(first_free * F.col("_w"), limit))
    shared = levels.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))
    return shared.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash: 53 bits, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(2 ** 53))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """Every row of `docs` with `_size`, `_source_size`, `_target` and `_copies` (0 or more).

    Null text: size 0. Null source: a source of its own, last in order. A source whose sizes sum to 0 has target 0 and
    takes nothing. Rows that repeat a doc_id with the same text draw alike. An empty table gives an empty one. Columns of
    other names, `size` and `rate` included, pass through.
    """
    sized = docs.withColumn("_size", word_count(F.col(text)))
    rates = materialise(source_rates(sized.select(F.col(source).alias("source"), F.col("_size").alias("size"))))
    rates = rates.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_source_size"),
                         F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, sized[source].eqNullSafe(rates["_mix_source"]), "left")
    extra = uniform(seed, F.col(doc_id), F.xxhash64(F.col(text))) < F.col("_rate") - F.floor("_rate")
    copies = F.floor("_rate") + F.when(extra, 1).otherwise(0)
    return joined.withColumn("_copies", F.coalesce(copies, F.lit(0)).cast("int")).drop("_mix_source", "_rate")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns it came with. The copies are made in
    the row, after all shuffles."""
    columns = [c for c in mixed.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    return (mixed.where(F.col("_copies") > 0)
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*columns))


def taken_words(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies."""
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"),
                        F.col("_copies").alias("copies"))
