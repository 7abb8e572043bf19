"""Amount parsing in the two dialects, numeric guards and text-to-double coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions.text import let, strip

_UNIT_WORDS = rf"(?U)\b(?:{'|'.join(V.AMOUNT_UNIT_WORDS)})\b"
_FLOAT = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
_SPECIAL = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _resolve_separators(body: Column, dialect: str) -> Column:
    """Rewrite so that at most the decimal mark is left as a dot."""
    dots, commas = _count(body, "."), _count(body, ",")
    no_commas, no_dots = F.replace(body, F.lit(","), F.lit("")), F.replace(body, F.lit("."), F.lit(""))
    grouped_comma = F.rlike(body, F.lit(r"(?s),.{1,3}$" if dialect == "service" else r"(?s),.{3}$"))
    return (
        F.when((dots > 0) & (commas > 0),
               F.when(F.rlike(body, F.lit(r"(?s),[^.]*$")), F.translate(body, ",.", ".")).otherwise(no_commas))
        .when((commas > 1) | ((commas == 1) & grouped_comma), no_commas)
        .when(commas == 1, F.translate(body, ",", "."))
        .when((dots > 1) | ((dots == 1) & F.rlike(body, F.lit(r"^[0-9]+\.[0-9]{3}$"))), no_dots)
        .otherwise(body)
    )


def parse_amount(text: Column, dialect: str = "module") -> Column:
    """Amount as a double, or null. `dialect` is 'module' or 'service'."""
    if dialect not in ("module", "service"):
        raise ValueError(f"unknown amount dialect: {dialect}")

    def to_number(resolved: Column, bracketed: Column) -> Column:
        digits = F.regexp_replace(resolved, r"[^0-9.]", "")
        if dialect == "service":
            digits = let(digits, lambda d: F.when(_count(d, ".") > 1, F.replace(d, F.lit("."), F.lit(""))).otherwise(d))
        size = let(digits, lambda d: F.when(F.rlike(d, F.lit(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")),
                                            d.try_cast("double")))
        signed = let(size, lambda v: F.when(F.startswith(resolved, F.lit("-")), -v).otherwise(v))
        return let(signed, lambda v: F.when(bracketed & (v >= 0), -v).otherwise(v))

    def parse(clean: Column) -> Column:
        bracketed = F.startswith(clean, F.lit("(")) & F.endswith(clean, F.lit(")"))
        body = F.when(bracketed, strip(F.substring(clean, F.lit(2), F.length(clean) - 2))).otherwise(clean)
        return let(body, lambda b: let(_resolve_separators(b, dialect), lambda r: to_number(r, bracketed)))

    clean = strip(F.regexp_replace(F.replace(F.lower(text), F.lit("rp"), F.lit("")), _UNIT_WORDS, ""))
    return F.when(F.rlike(text, F.lit("[0-9]")), let(clean, parse))


def maybe_numeric(text: Column) -> Column:
    """Has a digit and no run of three or more ASCII letters."""
    return F.rlike(text, F.lit(r"(?U)\d")) & ~F.rlike(text, F.lit("[a-zA-Z]{3,}"))


def to_double(text: Column) -> Column:
    """Text as Python's float() reads it, null where float() would fail."""
    def convert(t: Column) -> Column:
        return (
            F.when(F.rlike(t, F.lit(_FLOAT)), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
            .when(F.rlike(t, F.lit(_SPECIAL)), t.try_cast("double"))
        )
    return let(strip(text), convert)
