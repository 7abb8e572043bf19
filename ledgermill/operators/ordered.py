"""Running totals and neighbour look-ups over a global order without a single-partition window.

Rows are cut into ordered buckets by splitters taken from a hash sample of the order values. Windows run per bucket;
what a bucket needs from the others is carried over from one summary row per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

MIN_BUCKETS, SAMPLES_PER_BUCKET = 64, 64


def bucket_count(table: DataFrame) -> int:
    """As many buckets as shuffle partitions, and at least MIN_BUCKETS."""
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, partitions)


def with_bucket(table: DataFrame, order: str, buckets: int) -> DataFrame:
    """Add `bucket`, non-decreasing in `order`. The sample is the rows whose values have the smallest hashes, so the
    splitters depend on the data only, not on how it is partitioned; they come as a scalar subquery. The sample only
    balances the buckets: every row gets its bucket and takes part."""
    picked = (table.select(F.col(order).alias("v")).orderBy(F.xxhash64("v"), "v").limit(buckets * SAMPLES_PER_BUCKET)
              .agg(F.array_sort(F.collect_set("v")).alias("vs")))
    size = F.size("vs")
    cuts = picked.select(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.get(F.col("vs"), F.floor(i * size / buckets).cast("int")))).alias("cuts")).scalar()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(buckets.bit_length()))])       # binary search: cuts <= value
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(F.col("_cuts"), at + step - 1) <= F.col(order), at + step).otherwise(at))
    return table.withColumn("_cuts", cuts).withColumn("bucket", bucket).drop("_cuts")


def ordered_pass(table: DataFrame, keys: Sequence[str], order: str, totals: Sequence[str] = (),
                 previous: Mapping[str, Column] | None = None, following: Mapping[str, Column] | None = None,
                 buckets: int | None = None) -> DataFrame:
    """Per key, in ascending `order` (unique within a key), add:

    - `<v>_upto` and `<v>_total` for every column of `totals`: the sum up to and including the row, and over the key;
    - for every `previous` expression its nearest non-null value on an earlier row, for every `following` expression
      its nearest non-null value on a later row.
    """
    previous, following = previous or {}, following or {}
    cut = with_bucket(table, order, buckets or bucket_count(table)).withColumns({
        **{f"_p_{n}": e for n, e in previous.items()}, **{f"_f_{n}": e for n, e in following.items()}})
    key_cols = [*keys, "bucket"]
    inside = W.partitionBy(*key_cols).orderBy(order)
    key = W.partitionBy(*keys)            # one row per bucket: at most `buckets` rows per key
    across = key.orderBy("bucket")
    earlier, later = (W.unboundedPreceding, -1), (1, W.unboundedFollowing)

    def edge(kind: str, n: str) -> Column:
        present = F.when(F.col(f"_{kind}_{n}").isNotNull(), F.col(order))
        return (F.max_by if kind == "p" else F.min_by)(f"_{kind}_{n}", present).alias(f"_e{kind}_{n}")
    summary = cut.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(v).alias(f"_s_{v}") for v in totals],
        *[edge("p", n) for n in previous], *[edge("f", n) for n in following])
    carried = summary.select(
        *key_cols,
        *[F.coalesce(F.sum(f"_s_{v}").over(across.rowsBetween(*earlier)), F.lit(0)).alias(f"_c_{v}") for v in totals],
        *[F.sum(f"_s_{v}").over(key).alias(f"{v}_total") for v in totals],
        *[F.last(f"_ep_{n}", ignorenulls=True).over(across.rowsBetween(*earlier)).alias(f"_cp_{n}") for n in previous],
        *[F.first(f"_ef_{n}", ignorenulls=True).over(across.rowsBetween(*later)).alias(f"_cf_{n}") for n in following])
    local = cut.select(
        *table.columns, "bucket",
        *[F.sum(v).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias(f"_l_{v}") for v in totals],
        *[F.last(f"_p_{n}", ignorenulls=True).over(inside.rowsBetween(*earlier)).alias(f"_lp_{n}") for n in previous],
        *[F.first(f"_f_{n}", ignorenulls=True).over(inside.rowsBetween(*later)).alias(f"_lf_{n}") for n in following])
    carried = carried.withColumnsRenamed({c: f"_k_{c}" for c in key_cols})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key_cols]          # a null key is a key of its own
    return local.join(carried, same).select(
        *table.columns,
        *[(F.col(f"_l_{v}") + F.col(f"_c_{v}")).alias(f"{v}_upto") for v in totals], *[f"{v}_total" for v in totals],
        *[F.coalesce(f"_lp_{n}", f"_cp_{n}").alias(n) for n in previous],
        *[F.coalesce(f"_lf_{n}", f"_cf_{n}").alias(n) for n in following])
