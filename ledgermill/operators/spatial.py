"""Extraction from boxed words: phrase search over word sequences and a nearest-neighbour range join.

Boxes: doc_id, seq (position in the word list, 0..n-1 without gaps), text, x0, y0, x1, y1.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions.amounts import maybe_numeric, parse_amount
from ledgermill.functions.text import strip
from ledgermill.session import materialise
from ledgermill.sources.keywords import CORPORATE, KeywordSet

_END = "\x01"
_PUNCTUATION = r"(?U)[^\w\s]"
SEQ_CHUNK = 8192          # words per chunk of a document; neighbouring chunks overlap by a phrase length


def _clean(word):
    return F.regexp_replace(F.lower(word), _PUNCTUATION, "")


def phrase_hits(boxes: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    """Every place where the words of a variation stand in a row: doc_id, item, var_ord, seq, words, geometry."""
    runs: dict[tuple, list] = {}
    for item, var_ord, phrase, _ in keywords.phrases():
        runs.setdefault(tuple(phrase.split()), []).append((item, var_ord))
    longest = max(len(tokens) for tokens in runs)
    # A document is cut into chunks, and a chunk also gets the first words of the next one, so that a phrase across
    # the cut is seen whole and no document is one task.
    words = F.array(*[F.lit(w) for w in _clean_literals([w for tokens in runs for w in tokens])])
    own = F.floor(F.col("seq") / SEQ_CHUNK)
    chunks = F.when((F.col("seq") % SEQ_CHUNK < longest - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    # Only words of some phrase can be part of a hit; the others do not enter the shuffle.
    placed = (boxes.withColumn("word", _clean(F.col("text"))).where(F.array_contains(words, F.col("word")))
              .select("doc_id", "seq", "word", "x0", "y0", "x1", "y1", own.alias("own"), F.explode(chunks).alias("chunk")))
    order = W.partitionBy("doc_id", "chunk").orderBy("seq").rowsBetween(0, longest - 1)
    c = F.col
    ahead = (placed.withColumn("ahead", F.collect_list(F.struct("seq", "word", "x1", "y0", "y1")).over(order))
             .where(c("own") == c("chunk")).select("doc_id", "seq", "x0", "ahead"))
    # Words are compared as one text with a separator that no word contains.
    opening = F.array(*[F.lit(w) for w in sorted({_clean_literals(t, ordered=True)[0] for t in runs})])
    row = F.concat(F.array_join(F.transform(F.filter("ahead", lambda a, i: a["seq"] == c("seq") + i),
                                            lambda a: a["word"]), _END), F.lit(_END))
    table = F.array(*[
        F.struct(F.lit(item).alias("item"), F.lit(var_ord).alias("var_ord"), F.lit(len(tokens)).alias("words"),
                 F.lit("".join(w + _END for w in _clean_literals(tokens, ordered=True))).alias("run"))
        for tokens, uses in sorted(runs.items()) for item, var_ord in uses])
    hits = (ahead.where(F.array_contains(opening, F.get("ahead", F.lit(0))["word"])).withColumn("row", row)
            .withColumn("hit", F.explode_outer(F.filter(table, lambda t: F.startswith(c("row"), t["run"]))))
            .where(c("hit").isNotNull()))
    last = F.get("ahead", c("hit.words") - 1)
    return hits.select(
        "doc_id", c("hit.item").alias("item"), c("hit.var_ord").alias("var_ord"), "seq", c("hit.words").alias("words"),
        last["x1"].alias("right"), (last["x1"] - c("x0")).alias("width"), (last["y1"] - last["y0"]).alias("height"),
        ((last["y0"] + last["y1"]) / 2).alias("centre"))


def _clean_literals(words, ordered: bool = False) -> list[str]:
    cleaned = [re.sub(r"[^\w\s]", "", w.lower()) for w in words]
    return cleaned if ordered else sorted(set(cleaned))


def nearest_amounts(hits: DataFrame, boxes: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    """For every document and item the amount with the smallest gap to the right of a phrase on its line.

    Amounts fall into grid cells and a phrase looks into the cells that its search area touches, so the join is an
    equi join on (document, grid, cell). The cells of a phrase's grid are as large as its search area, rounded up to powers of
    two: it touches six of them at most, in whatever unit the page is measured, and an amount stands once in every grid
    that its document uses. Equal geometry is reduced to its earliest word or hit before the join.
    """
    digits = [p for _, _, p, _ in keywords.phrases() if any(ch.isdigit() for ch in p)]
    phrase_words = sorted({w for p in digits for w in p.split()})
    own_word = (_clean(F.col("text")).isin(_clean_literals(phrase_words)) if phrase_words else F.lit(False))
    amounts = (
        boxes.where(maybe_numeric(F.col("text")) & (strip(F.col("text")) != ""))
        .select("doc_id", F.col("x0").alias("left"), ((F.col("y0") + F.col("y1")) / 2).alias("mid"),
                F.col("seq").alias("word_seq"), parse_amount(F.col("text")).alias("value"),
                F.when(own_word, F.col("seq")).alias("own"))
        .where(F.col("value").isNotNull())
        .groupBy("doc_id", "left", "mid", "own")
        .agg(F.min("word_seq").alias("word_seq"), F.min_by("value", "word_seq").alias("value")))
    phrases = materialise(                              # read twice: for the grids and for the search
        hits.withColumn("own", F.lit(None).cast("bigint") if not phrase_words else F.col("seq"))
        .groupBy("doc_id", "item", "right", "width", "height", "centre", "own")
        .agg(F.min(F.struct("var_ord", "seq", "words")).alias("first"))
        .withColumns({"reach_y": F.col("height") * V.VERTICAL_FACTOR, "reach_x": F.col("width") * V.HORIZONTAL_FACTOR})
        .where((F.col("reach_y") > 0) & (F.col("reach_x") > 0))
        .withColumns({"grid_x": F.ceil(F.log2("reach_x")).cast("int"), "grid_y": F.ceil(F.log2("reach_y")).cast("int")}))
    width, height = F.pow(F.lit(2.0), F.col("grid_x")), F.pow(F.lit(2.0), F.col("grid_y"))
    # Spark's estimate of boxes that come from arrays or files is far below their number, and a side that is broadcast by it
    # may not fit the driver: both joins are merges, whatever the estimate.
    grids = phrases.select("doc_id", "grid_x", "grid_y").distinct().hint("merge")
    celled = amounts.drop("own").join(grids, "doc_id").withColumns(
        {"cell_x": F.floor(F.col("left") / width), "cell_y": F.floor(F.col("mid") / height)})
    looked = phrases.withColumn("cell_x", F.explode(F.sequence(
        F.floor(F.col("right") / width), F.floor((F.col("right") + F.col("reach_x")) / width)))).withColumn(
        "cell_y", F.explode(F.sequence(
            F.floor((F.col("centre") - F.col("reach_y")) / height),
            F.floor((F.col("centre") + F.col("reach_y")) / height))))
    gap = F.col("left") - F.col("right")
    near = looked.join(celled.hint("merge"), ["doc_id", "grid_x", "grid_y", "cell_x", "cell_y"]).where(
        (gap > 0) & (gap < F.col("reach_x")) & (F.abs(F.col("centre") - F.col("mid")) < F.col("reach_y"))
        & ~((F.col("word_seq") >= F.col("first.seq")) & (F.col("word_seq") < F.col("first.seq") + F.col("first.words"))))
    return near.groupBy("doc_id", "item").agg(F.min_by(
        "value", F.struct(gap.alias("gap"), F.col("first.var_ord"), F.col("first.seq"), "word_seq")).alias("value"))


def spatial_extract(boxes: DataFrame, keywords: KeywordSet = CORPORATE) -> DataFrame:
    """doc_id, item, value for every item whose phrase has an amount beside it."""
    found = nearest_amounts(phrase_hits(boxes, keywords), boxes, keywords)
    names = F.array(*[F.lit(n) for n in keywords.item_names])
    return found.select("doc_id", F.get(names, F.col("item")).alias("item"), "value")
