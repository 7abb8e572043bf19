"""Reporting year and unit multiplier announced at the head of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions.text import let


def _years(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    years = F.transform(hits, lambda m: F.right(m, F.lit(4)).cast("int"))
    return F.array_max(F.filter(years, lambda y: (y >= 2000) & (y <= 2099)))


def report_year(text: Column, head: int = V.YEAR_CHARS) -> Column:
    """Latest year 2000-2099 announced in the first `head` characters, as text; null if there is none."""
    return let(
        F.lower(F.substring(text, 1, head)),
        lambda t: F.when(F.rlike(t, F.lit("[12][0-9]{3}")), F.coalesce(
            F.greatest(_years(t, V.YEAR_CONTEXT_PATTERN), _years(t, V.YEAR_ALONE_PATTERN)),
            _years(t, V.YEAR_FALLBACK_PATTERN)).cast("string")),
    )


def unit_multiplier(text: Column) -> Column:
    """Multiplier of the first unit phrase in the first 1000 characters, else 1."""
    unit = F.lower(F.regexp_extract(F.substring(text, 1, V.UNIT_CHARS), V.UNIT_PATTERN, 1))

    def lookup(u: Column) -> Column:
        out = F.lit(1.0)
        for word, factor in V.UNIT_MULTIPLIERS.items():
            out = F.when(u == word, F.lit(factor)).otherwise(out)
        return out
    return F.coalesce(let(unit, lookup), F.lit(1.0))
