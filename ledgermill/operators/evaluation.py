"""Extraction quality against ground truth, detection scores, coverage and class reports.

Extractions: one row per document with nama_file and `items`: MAP<STRING, STRUCT<t, ...>> or MAP<STRING, DOUBLE>, and
optionally `error_flag` (any failed step) and `info_parsing`. Ground truth: one row per stem with `truth`: MAP<STRING,
DOUBLE>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermill import fixed_values as V
from ledgermill.functions.text import file_stem
from ledgermill.operators.roc import auc, roc_points
from ledgermill.sources.keywords import CORPORATE, KeywordSet


def value_t(table: DataFrame, entry: Column, column: str = "items") -> Column:
    """Value for t of a map entry, for maps of pairs as well as of plain numbers."""
    return entry["t"] if isinstance(table.schema[column].dataType.valueType, T.StructType) else entry


def evaluable(extractions: DataFrame) -> DataFrame:
    """Documents without an error flag and without a note about an empty text."""
    out = extractions.where(F.col("items").isNotNull() & (F.coalesce(F.col("nama_file"), F.lit("")) != ""))
    if "error_flag" in extractions.columns:
        out = out.where(F.coalesce(F.col("error_flag"), F.lit("")) == "")
    if "info_parsing" in extractions.columns:
        out = out.where(~F.coalesce(F.contains(F.col("info_parsing"), F.lit("kosong")), F.lit(False)))
    return out


def with_truth(extractions: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents that have ground truth under their file stem."""
    return extractions.withColumn("stem", file_stem(F.col("nama_file"))).join(truth, "stem")


def _matched(extractions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per item that stands in the truth or the extraction of a document. Both maps travel in the document
    row, so the full outer match on the item happens inside the row, after one join on the stem."""
    docs = with_truth(evaluable(extractions), truth)
    names = F.array_union(F.map_keys("items"), F.map_keys("truth"))
    rows = docs.select("items", "truth", F.explode(F.filter(
        names, lambda n: F.map_contains_key(F.col("truth"), n)
        | ~(F.startswith(n, F.lit("error_")) | F.startswith(n, F.lit("info_"))))).alias("item"))
    entry = F.try_element_at(F.col("items"), F.col("item"))
    return rows.select(
        "item", value_t(extractions, entry).alias("t"), F.map_contains_key(F.col("truth"), F.col("item")).alias("wanted"),
        F.try_element_at(F.col("truth"), F.col("item")).alias("value"))


def _guarded(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(num / den)


def compare_with_truth(extractions: DataFrame, truth: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    """Per item: counts, precision, recall, F1, detection and exact-match rate, mean absolute and percentage error.

    Items of the keyword set without any occurrence get a zero row; rates without a base are null.
    """
    m = _matched(extractions, truth)
    c = F.col
    found, both = c("t").isNotNull(), c("t").isNotNull() & c("value").isNotNull() & c("wanted")
    error = F.abs(c("t") - c("value"))
    share = (F.when(c("value") != 0, F.abs((c("t") - c("value")) / c("value")) * 100)
             .when(c("t") != 0, 100.0).otherwise(0.0))
    counts = m.groupBy("item").agg(
        F.count_if(c("wanted") & found).alias("tp"), F.count_if(~c("wanted") & found).alias("fp"),
        F.count_if(c("wanted") & ~found).alias("fn"), F.count_if(c("wanted")).alias("gt_occurrences"),
        F.count_if(both & (c("t") == c("value"))).alias("exact_value_matches"),
        F.count_if(both).alias("numeric_pairs"),
        F.sum(F.when(both, error)).alias("error_sum"), F.sum(F.when(both, share)).alias("share_sum"))
    zeros = extractions.sparkSession.createDataFrame([(n,) for n in keywords.item_names], "item STRING").select(
        "item", *[F.lit(0).cast("bigint").alias(n) for n in
                  ("tp", "fp", "fn", "gt_occurrences", "exact_value_matches", "numeric_pairs")],
        F.lit(None).cast("double").alias("error_sum"), F.lit(None).cast("double").alias("share_sum"))
    names = [n for n in counts.columns if n != "item"]
    full = counts.unionByName(zeros).groupBy("item").agg(*[F.sum(n).alias(n) for n in names])
    rated = full.withColumns({"_p": _guarded(c("tp"), c("tp") + c("fp")), "_r": _guarded(c("tp"), c("tp") + c("fn"))})
    f1 = _guarded(2 * (c("_p") * c("_r")), c("_p") + c("_r"))
    return rated.select(
        "item", "tp", "fp", "fn", "gt_occurrences", c("tp").alias("detected"), "exact_value_matches", "numeric_pairs",
        (c("_p") * 100).alias("precision"), (c("_r") * 100).alias("recall"), (f1 * 100).alias("f1_score"),
        (F.try_divide("tp", "gt_occurrences") * 100).alias("detection_rate"),
        (F.try_divide("exact_value_matches", "gt_occurrences") * 100).alias("exact_match_rate"),
        F.try_divide("error_sum", "numeric_pairs").alias("mean_absolute_error"),
        F.try_divide("share_sum", "numeric_pairs").alias("mean_percentage_error"))


def overall_accuracy(metrics: DataFrame) -> DataFrame:
    """Exact matches over all truth items, in percent; 0 when there are none."""
    sums = metrics.agg(F.coalesce(F.sum("gt_occurrences"), F.lit(0)).alias("truth_items"),
                       F.coalesce(F.sum("exact_value_matches"), F.lit(0)).alias("exact_matches"))
    return sums.withColumn("accuracy_percentage", _guarded(F.col("exact_matches"), F.col("truth_items")) * 100)


def coverage(extractions: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    """Documents in which an item of the set has a value for t, and the number of documents."""
    docs = extractions.where(F.col("items").isNotNull())
    found = F.filter(F.array(*[F.lit(n) for n in keywords.item_names]), lambda n: value_t(
        extractions, F.try_element_at(F.col("items"), n)).isNotNull())
    # the null name counts documents, so that one pass gives both numbers
    rows = docs.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), found)).alias("item"))
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("documents_found"))
    total = counts.where(F.col("item").isNull()).select(F.col("documents_found").alias("documents")).scalar()
    return counts.where(F.col("item").isNotNull()).select("item", "documents_found", total.alias("documents"))


def heuristic_scores(extractions: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    """nama_file, item, score, value for every document and item of the set."""
    rows = extractions.where(F.col("items").isNotNull()).select(
        "nama_file", "items", F.explode(F.array(*[F.lit(n) for n in keywords.item_names])).alias("item"))
    value = value_t(extractions, F.try_element_at(F.col("items"), F.col("item")))
    return rows.select("nama_file", "item", F.when(value.isNotNull(), V.SCORE_FOUND).otherwise(V.SCORE_ABSENT)
                       .alias("score"), value.alias("value"))


def detection_hits(extractions: DataFrame, truth: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    """Scored rows (score, hit) of the documents that have truth; hit means that the item stands in the truth."""
    docs = with_truth(extractions.where(F.col("items").isNotNull()), truth)
    rows = docs.select("items", "truth", F.explode(F.array(*[F.lit(n) for n in keywords.item_names])).alias("item"))
    value = value_t(extractions, F.try_element_at(F.col("items"), F.col("item")))
    return rows.select(F.when(value.isNotNull(), V.SCORE_FOUND).otherwise(V.SCORE_ABSENT).alias("score"),
                       F.map_contains_key(F.col("truth"), F.col("item")).alias("hit"))


def detection_roc(extractions: DataFrame, truth: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    return roc_points(detection_hits(extractions, truth, keywords))


def detection_auc(extractions: DataFrame, truth: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    return auc(detection_hits(extractions, truth, keywords))


def class_report(predictions: DataFrame, classes: Sequence[str], label: str = "label",
                 prediction: str = "prediction") -> DataFrame:
    """Rows per class and 'accuracy', 'macro avg', 'weighted avg': precision, recall, f1_score, support."""
    confusion = predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("rows"))
    c = F.col
    sides = F.array_distinct(F.array("label", "prediction"))
    per_class = (
        confusion.select("label", "prediction", "rows", F.explode(sides).alias("class"))
        .unionByName(confusion.sparkSession.createDataFrame([(k,) for k in classes], "class STRING").select(
            F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("prediction"),
            F.lit(0).cast("bigint").alias("rows"), "class"))
        .where(c("class").isin(list(classes))).groupBy("class").agg(
            F.sum(F.when((c("label") == c("class")) & (c("prediction") == c("class")), c("rows")).otherwise(0)).alias("tp"),
            F.sum(F.when(c("prediction") == c("class"), c("rows")).otherwise(0)).alias("predicted"),
            F.sum(F.when(c("label") == c("class"), c("rows")).otherwise(0)).alias("support")))
    p, r = _guarded(c("tp"), c("predicted")), _guarded(c("tp"), c("support"))
    rated = per_class.withColumns({"precision": p, "recall": r}).withColumn(
        "f1_score", _guarded(2 * (c("precision") * c("recall")), c("precision") + c("recall")))
    measures = ["precision", "recall", "f1_score"]
    rows = rated.select("class", *measures, "support")
    total = F.sum("support")
    averages = rated.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[F.try_divide(F.sum(c(m) * c("support")), total).alias(f"weighted_{m}") for m in measures],
        F.try_divide(F.sum("tp"), total).alias("accuracy"), total.alias("support"))
    none = F.lit(None).cast("double")
    summary = averages.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"),
                 c("accuracy").alias("f1_score"), c("support").alias("support")),
        *[F.struct(F.lit(f"{kind} avg").alias("class"), *[c(f"{kind}_{m}").alias(m) for m in measures],
                   c("support").alias("support")) for kind in ("macro", "weighted")])))
    return rows.unionByName(summary)


def distribution(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts by each of the columns in one pass: column_name, value, rows."""
    entries = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in columns])
    return table.select(F.inline(entries)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
