"""String helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.strip and \s see it in Unicode mode; the control separators are not in Java's class.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + (
    "\u2028\u2029\u202f\u205f\u3000")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside an expression (also inside a lambda)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"(?U)[^\s\x1c-\x1f]"))


def collapse_spaces(text: Column) -> Column:
    """White-space runs become one blank; no leading or trailing blank."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def document_form(text: Column) -> Column:
    """Collapsed and lower-cased text, the form in which phrases are searched."""
    return F.lower(collapse_spaces(text))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | F.startswith(text, F.lit(prefix))
    return found


def words(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased alphanumeric tokens without stop words."""
    tokens = F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: F.rlike(w, F.lit(r"^(?U)[\p{L}\p{N}]+$")))
    if not stop_words:
        return tokens
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens, lambda w: ~F.array_contains(stops, w))


def file_stem(name: Column) -> Column:
    """Name without its last extension, as os.path.splitext cuts it."""
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.]\.([^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def applicant_slug(name: Column) -> Column:
    """Word characters, blanks and hyphens only; blanks become underscores."""
    return F.translate(strip(F.regexp_replace(name, r"(?U)[^\w\s-]", "")), " ", "_")


def display_time(utc: Column) -> Column:
    """UTC instant shown as Jakarta wall-clock time."""
    return F.concat(F.date_format(F.from_utc_timestamp(utc, "Asia/Jakarta"), "dd MMMM yyyy, HH:mm"), F.lit(" WIB"))


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar; absent parts are left out."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def is_parent_page(text: Column, phrases: Sequence[str], head: int) -> Column:
    return contains_any(F.lower(F.substring(text, 1, head)), phrases)
