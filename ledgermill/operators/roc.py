"""ROC points and areas: one score, one-vs-rest, micro, macro and one-vs-one.

Scored rows: key columns (may be none), `score` DOUBLE, `hit` BOOLEAN or 0/1. Rows are counted per score before any
ordering, and the order runs over buckets (see `ordered`). Areas are quotients of exact integer sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.ordered import ordered_pass
from ledgermill.session import materialise

COUNT = "decimal(38,0)"


def _per_score(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per score, computed once: the ordered pass reads them several times."""
    hit = F.col("hit").cast("int")
    return materialise(scored.groupBy(*keys, "score").agg(
        F.sum(hit).cast("bigint").alias("p"), F.sum(1 - hit).cast("bigint").alias("n")))


def _points(per_score: DataFrame, keys: Sequence[str], drop_collinear: bool) -> DataFrame:
    """Points of every key with both classes, from counts p, n per score; `score` falls along the curve."""
    c, pair = F.col, F.struct("p", "n")
    if drop_collinear:
        steps = ordered_pass(per_score, keys, "score", ["p", "n"], {"lower": pair}, {"higher": pair})
        steps = steps.where(c("lower").isNull() | c("higher").isNull() | (c("lower") != pair))
    else:
        steps = ordered_pass(per_score, keys, "score", ["p", "n"])
    return steps.where((c("p_total") > 0) & (c("n_total") > 0)).select(
        *keys, "score", ((c("n_total") - c("n_upto") + c("n")) / c("n_total")).alias("fpr"),
        ((c("p_total") - c("p_upto") + c("p")) / c("p_total")).alias("tpr"))


def _corners(per_score: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The start point of every curve; the whole diagonal where a class is absent."""
    ends = per_score.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    defined = (F.col("p") > 0) & (F.col("n") > 0)
    return ends.select(*keys, F.lit(None).cast("double").alias("score"), F.explode(
        F.when(defined, F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))).alias("fpr")
    ).withColumn("tpr", F.col("fpr"))


def roc_points(scored: DataFrame, keys: Sequence[str] = (), drop_collinear: bool = False) -> DataFrame:
    """keys, score, fpr, tpr: one point per distinct score and a start point with null score.

    Without positives or negatives the curve is the diagonal. `drop_collinear` leaves out inner points whose step
    equals the next one.
    """
    per_score = _per_score(scored, keys)
    return _points(per_score, keys, drop_collinear).unionByName(_corners(per_score, keys))


def _areas(per_score: DataFrame, keys: Sequence[str]) -> DataFrame:
    c = F.col
    steps = ordered_pass(per_score, keys, "score", ["p"])
    above = c("p_total") - c("p_upto")
    sums = steps.groupBy(*keys).agg(
        F.sum(c("n").cast(COUNT) * (2 * above + c("p")).cast(COUNT)).cast("double").alias("area2"),
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    area = F.when((c("positives") > 0) & (c("negatives") > 0),
                  c("area2") / (2.0 * c("positives").cast("double") * c("negatives").cast("double"))).otherwise(0.5)
    return sums.select(*keys, "positives", "negatives", area.alias("auc"))


def auc(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, positives, negatives, auc: trapezoid area, 0.5 where a class is absent."""
    return _areas(_per_score(scored, keys), keys)


def class_rows(predictions: DataFrame, classes: Sequence[str], label: str = "label",
               probabilities: str = "probabilities") -> DataFrame:
    """One row (class, score, hit) per prediction and class; probabilities is MAP<class, DOUBLE>."""
    entries = F.array(*[F.struct(F.lit(k).alias("class"), F.try_element_at(F.col(probabilities), F.lit(k)).alias("score"),
                                 (F.col(label) == k).alias("hit")) for k in classes])
    return predictions.select(F.inline(entries))


def macro_curve(per_score: DataFrame, classes: Sequence[str]) -> DataFrame:
    """fpr, tpr of the macro average: every class curve read at the union of all fpr values, then averaged.

    Input: class, score, p, n. Between knots a curve is linear; at a repeated fpr the highest tpr counts.
    """
    c = F.col
    knots = (_points(per_score, ["class"], True).unionByName(_corners(per_score, ["class"])).groupBy("class", "fpr")
             .agg(F.min("tpr").alias("low"), F.max("tpr").alias("high")))
    knots = materialise(knots)
    none = F.lit(None).cast("double")
    grid = knots.select(F.explode(F.array(*[F.lit(k) for k in classes])).alias("class"), "fpr",
                        none.alias("low"), none.alias("high"))
    points = (knots.unionByName(grid).groupBy("class", "fpr").agg(F.max("low").alias("low"), F.max("high").alias("high")))
    knot = c("high").isNotNull()
    around = ordered_pass(points, ["class"], "fpr", (),
                          {"left": F.when(knot, F.struct("fpr", c("high").alias("tpr")))},
                          {"right": F.when(knot, F.struct("fpr", c("low").alias("tpr")))})
    slope = (c("right.tpr") - c("left.tpr")) / (c("right.fpr") - c("left.fpr"))
    read = around.withColumn("tpr", F.coalesce(c("high"), slope * (c("fpr") - c("left.fpr")) + c("left.tpr")))
    per_class = [F.max(F.when(c("class") == k, c("tpr"))).alias(f"_t{i}") for i, k in enumerate(classes)]
    total = F.lit(0.0)
    for i in range(len(classes)):
        total = total + c(f"_t{i}")
    return materialise(read.groupBy("fpr").agg(*per_class).select("fpr", (total / len(classes)).alias("tpr")))


def curve_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area of a curve (fpr, tpr) with one tpr per fpr."""
    stepped = ordered_pass(curve, [], "fpr", (), {"before": F.struct("fpr", "tpr")})
    c = F.col
    return stepped.agg(F.sum((c("fpr") - c("before.fpr")) * (c("tpr") + c("before.tpr")) / 2).alias("auc"))


def multiclass_auc(predictions: DataFrame, classes: Sequence[str], label: str = "label",
                   probabilities: str = "probabilities", macro: bool = True) -> DataFrame:
    """Rows (measure, class, auc): one per class, and micro, macro, ovr_macro, ovr_weighted, ovo_macro, ovo_weighted.

    The predictions are read once and counted per (class, label, score); every curve is a regrouping of these counts,
    and all areas come out of one ordered pass.
    """
    c = F.col
    known = [F.struct(F.lit(k).alias("class"), F.try_element_at(c(probabilities), F.lit(k)).alias("score")) for k in classes]
    counts = materialise(
        predictions.select(c(label).alias("label"), F.inline(F.array(*known)))
        .groupBy("class", "label", "score").agg(F.count(F.lit(1)).alias("rows")))
    hit = c("class") == c("label")

    def curve(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    others = F.transform(F.filter(F.array(*[F.lit(k) for k in classes]), lambda k: k != c("class")),
                         lambda k: curve("ovo", c("class"), k))
    pairs = F.when(hit, others).otherwise(F.array(curve("ovo", c("class"), c("label"))))
    curves = F.concat(F.array(curve("class", c("class"), F.lit("")), curve("micro", F.lit(""), F.lit(""))), pairs)
    keys = ["kind", "a", "b"]
    per_score = materialise(
        counts.select("score", "rows", hit.alias("hit"), F.inline(curves)).groupBy(*keys, "score").agg(
            F.sum(F.when(c("hit"), c("rows")).otherwise(0)).alias("p"),
            F.sum(F.when(c("hit"), 0).otherwise(c("rows"))).alias("n")))
    areas = _areas(per_score, keys)
    directed = c("kind") == "ovo"
    pooled = areas.groupBy("kind", F.when(directed, F.least("a", "b")).otherwise(c("a")).alias("a"),
                           F.when(directed, F.greatest("a", "b")).alias("b")).agg(
        F.avg("auc").alias("auc"), F.max("positives").alias("positives"),
        F.max(c("positives") + c("negatives")).alias("rows"))
    weight = F.when(c("kind") == "ovo", c("rows")).otherwise(c("positives"))
    means = pooled.where(c("kind") != "micro").groupBy("kind").agg(
        F.avg("auc").alias("macro"), F.try_divide(F.sum(c("auc") * weight), F.sum(weight)).alias("weighted"))
    prefix = F.when(c("kind") == "ovo", "ovo").otherwise("ovr")
    none = F.lit(None).cast("string")
    out = (pooled.where(c("kind") != "ovo")
           .select(c("kind").alias("measure"), F.when(c("kind") == "class", c("a")).alias("class"), "auc")
           .unionByName(means.select(
               F.inline(F.array(F.struct(F.concat(prefix, F.lit("_macro")).alias("measure"), c("macro").alias("auc")),
                                F.struct(F.concat(prefix, F.lit("_weighted")).alias("measure"), c("weighted").alias("auc"))))
           ).select("measure", none.alias("class"), "auc")))
    if not macro:
        return out
    by_class = per_score.where(c("kind") == "class").select(c("a").alias("class"), "score", "p", "n")
    return out.unionByName(curve_area(macro_curve(by_class, classes))
                           .select(F.lit("macro").alias("measure"), none.alias("class"), "auc"))
