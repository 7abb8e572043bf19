"""Joins with a side of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.session import materialise

MOST_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(table: DataFrame, most_rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """The table, computed once; marked for broadcast if it has at most `most_rows` rows (of a few numbers each). Beyond
    that Spark joins it by a shuffle."""
    table = materialise(table)
    return F.broadcast(table) if table.limit(most_rows + 1).count() <= most_rows else table
