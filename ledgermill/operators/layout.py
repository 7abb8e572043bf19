"""OCR words and text blocks to lines, pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions.text import collapse_spaces, is_blank, is_parent_page, strip


def _joined(rows: Column, field: str, separator: str) -> Column:
    """Texts of sorted structs joined by a separator."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r[field]), separator)


def lines_from_words(words: DataFrame) -> DataFrame:
    """Word rows (doc_id, page, block, par, line, word_ord, level, text) to one row per non-empty line.

    One group is one printed line, whose text is the output itself."""
    kept = words.where((F.col("level") == 5) & ~is_blank(F.col("text")))
    lines = (kept.groupBy("doc_id", "page", "block", "par", "line")
             .agg(F.collect_list(F.struct("word_ord", strip(F.col("text")).alias("text"))).alias("words")))
    return (lines.withColumn("line_text", collapse_spaces(_joined(F.col("words"), "text", " ")))
            .drop("words").where(F.col("line_text") != ""))


def lines_from_blocks(blocks: DataFrame, gap: int = V.LINE_GAP) -> DataFrame:
    """Blocks (doc_id, seq, x_min, y_min, text) to lines: a new line starts where y_min is more than `gap` away from
    the previous block in (y_min, x_min, seq) order.

    Blocks of one height never part, so they are joined per (doc_id, y_min) first; only the distinct heights of a page
    image reach the window.
    """
    rows = (blocks.where(~is_blank(F.col("text"))).groupBy("doc_id", "y_min")
            .agg(F.collect_list(F.struct("x_min", "seq", "text")).alias("row")))
    rows = rows.withColumn("row", _joined(F.col("row"), "text", " "))
    order = W.partitionBy("doc_id").orderBy("y_min")
    starts = F.when(F.col("y_min") - F.lag("y_min").over(order) > gap, 1).otherwise(0)
    numbered = (rows.withColumn("start", starts)
                .withColumn("line_no", F.sum("start").over(order.rowsBetween(W.unboundedPreceding, 0))))
    return (numbered.groupBy("doc_id", "line_no").agg(F.collect_list(F.struct("y_min", "row")).alias("rows"))
            .select("doc_id", "line_no", collapse_spaces(_joined(F.col("rows"), "row", " ")).alias("line_text"))
            .where(F.col("line_text") != ""))


def parent_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text) of the parent entity; the text is stripped."""
    stripped = pages.withColumn("text", strip(F.col("text")))
    return stripped.where(is_parent_page(F.col("text"), V.PARENT_PAGE_PHRASES, V.PAGE_HEAD_CHARS))


def document_text(pages: DataFrame, parent_only: bool = True) -> DataFrame:
    """Pages to one text per document in page order, joined by a blank line; no kept page gives an empty text.

    Dropped pages become null before the shuffle, so only kept text moves."""
    text = strip(F.col("text"))
    keep = text != ""
    if parent_only:
        keep = keep & is_parent_page(text, V.PARENT_PAGE_PHRASES, V.PAGE_HEAD_CHARS)
    parts = pages.select("doc_id", F.when(keep, F.struct("page_no", text.alias("text"))).alias("page"))
    return (parts.groupBy("doc_id").agg(F.collect_list("page").alias("kept"))
            .select("doc_id", _joined(F.col("kept"), "text", "\n\n").alias("text")))
