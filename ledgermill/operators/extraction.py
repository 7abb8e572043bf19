"""Two-period statement extraction from document text.

A document is one row and stays one row: phrases, occurrences, tokens and amounts are nested arrays of that row, so
the whole extraction is a narrow projection without join or shuffle. The windows behind an occurrence are bounded
(tokens or characters), so the work is linear in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions.amounts import parse_amount
from ledgermill.functions.headers import report_year, unit_multiplier
from ledgermill.functions.text import base_name, contains_any, document_form, is_blank, let, strip
from ledgermill.sources.keywords import CORPORATE, INDIVIDUAL, KeywordSet

PAIR = "STRUCT<t: DOUBLE, t_minus_1: DOUBLE>"
_TOKEN_WINDOW = r"((?: ?[^ ]++){0,%d})" % V.MODULE_TOKENS
_CHAR_WINDOW = r"((?s:.{0,%d}))" % V.SERVICE_CHARS


def _quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def _occurrence_pattern(phrase: str, item: int, phrases: list, window: str, longest: bool) -> str:
    """Matches the phrase and captures the text window behind it. With `longest`, an occurrence that lies inside a
    longer phrase of another item does not match."""
    inside = ""
    if longest:
        for other in sorted({p for i, _, p, _ in phrases if i != item and p != phrase and phrase in p}):
            for hit in re.finditer(f"(?={re.escape(phrase)})", other):
                before, rest = other[:hit.start()], other[hit.start():]
                inside += f"(?!{f'(?<={_quote(before)})' if before else ''}{_quote(rest)})"
    return f"{inside}{_quote(phrase)}(?={window})"


def _present(text: Column, entries: list[Column], phrases: list[str]) -> Column:
    """The entries (structs with `ord` and `phrase`) whose phrase stands in the text, by `ord`."""
    groups = F.array(*[F.struct(F.lit(word).alias("word"), F.array(*[entries[k] for k in members]).alias("entries"))
                       for word, members in KeywordSet.anchors(phrases)])
    near = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(text, g["word"])), lambda g: g["entries"]))
    return F.array_sort(F.filter(near, lambda p: F.contains(text, p["phrase"])))


def _leading_amounts(tokens: Column, dialect: str) -> Column:
    """The first two tokens that are amounts, as structs (i, v). Only where one of the first two tokens with a digit is
    no amount, the others are parsed too."""
    with_digit = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("s"))),
                          lambda t: F.rlike(t["s"], F.lit("[0-9]")))

    def parsed(part: Column) -> Column:
        return F.filter(F.transform(part, lambda t: F.struct(t["i"].alias("i"), parse_amount(t["s"], dialect).alias("v"))),
                        lambda n: n["v"].isNotNull())
    return let(with_digit, lambda ts: let(parsed(F.slice(ts, 1, V.VALUES_KEPT)), lambda head: F.when(
        (F.size(head) == V.VALUES_KEPT) | (F.size(ts) <= V.VALUES_KEPT), head).otherwise(
        F.slice(parsed(ts), 1, V.VALUES_KEPT))))


def _first_values(tail: Column, item_ord: Column, guards: Column, dialect: str, tokens_kept: int) -> Column:
    """At most two amounts of the window; cut where a phrase of another item stands before the amount."""
    def scan(tokens: Column) -> Column:
        allowed = F.filter(
            _leading_amounts(tokens, dialect),
            lambda n: let(F.array_join(F.slice(tokens, F.lit(1), n["i"]), " "),
                          lambda before: ~F.exists(F.element_at(guards, item_ord + 1),
                                                   lambda g: F.contains(before, g))))
        return F.transform(allowed, lambda n: n["v"])
    return let(F.slice(F.split(strip(tail), " "), 1, tokens_kept), scan)


def phrase_windows(form: Column, phrase: Column, dialect: str = "module") -> Column:
    """The text behind each occurrence of a phrase (a column), where it has a digit. `form` is a text in document form."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(quoted, F.lit(f"(?={_CHAR_WINDOW if dialect == 'service' else _TOKEN_WINDOW})"))
    return F.filter(F.regexp_extract_all(form, pattern, F.lit(1)), lambda w: F.rlike(w, F.lit("[0-9]")))


def window_values(window: Column, guards: Column, dialect: str = "module") -> Column:
    """At most two amounts of a window, cut where one of the guard phrases (an array) stands before an amount."""
    return _first_values(window, F.lit(0), F.array(guards), dialect, V.SERVICE_TOKENS if dialect == "service" else V.MODULE_TOKENS)


def _split_rule_values(text: Column, keywords: KeywordSet, dialect: str) -> list[tuple[int, Column]]:
    out = []
    for rule in keywords.split_rules:
        if rule.item not in keywords.item_names:
            continue
        windows = F.regexp_extract_all(
            text, F.lit(f"{_quote(rule.prefix)}(?=((?s:.{{0,{rule.window}}})))"), F.lit(1))
        between = F.transform(
            F.filter(windows, lambda w: F.contains(w, F.lit(rule.suffix))),
            lambda w: F.substring(w, F.lit(1), F.instr(w, F.lit(rule.suffix)) - 1))
        fitting = F.filter(between, lambda b: ~contains_any(b, rule.stops))
        values = F.transform(fitting, lambda b: F.slice(F.filter(
            F.transform(F.regexp_extract_all(b, F.lit(V.SPLIT_AMOUNT), F.lit(1)),
                        lambda n: parse_amount(n, dialect)), lambda v: v.isNotNull()), 1, V.VALUES_KEPT))
        out.append((keywords.item_names.index(rule.item),
                    F.get(F.filter(values, lambda v: F.size(v) > 0), F.lit(0))))
    return out


def extract_items(text: Column, multiplier: Column, keywords: KeywordSet = CORPORATE, dialect: str = "module",
                  match: str = "substring") -> Column:
    """MAP of every item of the set to its values for t and t-1 (null where nothing was found)."""
    if match not in ("substring", "longest"):
        raise ValueError(f"unknown match mode: {match}")
    service = dialect == "service"
    phrases = keywords.phrases(longest_first=service)
    window, kept = (_CHAR_WINDOW, V.SERVICE_TOKENS) if service else (_TOKEN_WINDOW, V.MODULE_TOKENS)
    exclusive = {(r.item, f"{r.prefix} {r.suffix}") for r in keywords.split_rules if r.exclusive}
    searched, texts, seen = [], [], set()
    for i, _, phrase, _ in phrases:
        if (keywords.item_names[i], phrase) in exclusive or (i, phrase) in seen:
            continue
        seen.add((i, phrase))
        texts.append(phrase)
        searched.append(F.struct(
            F.lit(len(searched)).alias("ord"), F.lit(i).alias("item"), F.lit(phrase).alias("phrase"),
            F.lit(_occurrence_pattern(phrase, i, phrases, window, match == "longest")).alias("pattern")))
    guards = F.array(*[F.array(*[F.lit(g) for g in gs]).cast("array<string>") for gs in keywords.guards()])

    def search(prepared: Column) -> Column:
        present = (_present(prepared, searched, texts) if searched else
                   F.array().cast("array<struct<ord:int,item:int,phrase:string,pattern:string>>"))
        windows = F.flatten(F.transform(present, lambda p: F.transform(
            F.filter(F.regexp_extract_all(prepared, p["pattern"], F.lit(1)), lambda w: F.rlike(w, F.lit("[0-9]"))),
            lambda w: F.struct(p["item"].alias("item"), w.alias("tail")))))
        found = F.filter(
            F.transform(windows, lambda o: F.struct(
                o["item"].alias("item"), _first_values(o["tail"], o["item"], guards, dialect, kept).alias("vals"))),
            lambda o: F.size(o["vals"]) > 0)

        def by_item(hits: Column) -> Column:
            split_values = dict(_split_rule_values(prepared, keywords, dialect))
            per_item = []
            for i, name in enumerate(keywords.item_names):
                vals = F.get(F.filter(hits, lambda h: h["item"] == i), F.lit(0))["vals"]
                if i in split_values:
                    vals = F.coalesce(split_values[i], vals)
                pair = let(vals, lambda v: F.struct(
                    (F.get(v, F.lit(0)) * multiplier).alias("t"),
                    (F.get(v, F.lit(1)) * multiplier).alias("t_minus_1")))
                per_item.extend([F.lit(name), pair])
            return F.create_map(*per_item)
        return let(found, by_item)

    return let(F.coalesce(document_form(text), F.lit("")), search)


def annual_extract(documents: DataFrame, keywords: KeywordSet = CORPORATE, dialect: str = "module",
                   match: str = "substring", text_col: str = "text",
                   multiplier: Column | None = None) -> DataFrame:
    """Replace the text column by `items`: MAP<item, STRUCT<t, t_minus_1>>. The multiplier defaults to 1."""
    items = extract_items(F.col(text_col), F.lit(1.0) if multiplier is None else multiplier, keywords, dialect, match)
    return documents.withColumn("items", items).drop(text_col)


def items_long(extracted: DataFrame, items_col: str = "items") -> DataFrame:
    """One row per document and item, with columns t and t_minus_1."""
    keep = [c for c in extracted.columns if c != items_col]
    # outer: a plain explode makes the optimizer evaluate the map once more in a filter below it
    return (extracted.select(*keep, F.explode_outer(items_col).alias("item", "pair")).where(F.col("item").isNotNull())
            .select(*keep, "item", F.col("pair.t").alias("t"), F.col("pair.t_minus_1").alias("t_minus_1")))


def split_periods(long_items: DataFrame) -> DataFrame:
    """One row per document, item and period kind ('t', 't-1'); rows without a value are dropped."""
    keep = [c for c in long_items.columns if c not in ("t", "t_minus_1")]
    kinds = F.array(F.struct(F.lit("t").alias("period_kind"), F.col("t").alias("value")),
                    F.struct(F.lit("t-1").alias("period_kind"), F.col("t_minus_1").alias("value")))
    return long_items.select(*keep, F.inline(F.filter(kinds, lambda k: k["value"].isNotNull())))


def two_values(text: Column, keywords: KeywordSet = CORPORATE) -> Column:
    """MAP of the items found to their first two amounts (val1, val2).

    A phrase counts if no longer phrase of the set that contains it stands in the text too. From its first occurrence
    on, the next amounts of the whole text are taken; values of an item add up over its spellings.
    """
    runs = keywords.phrases()
    entries = [F.struct(F.lit(k).alias("ord"), F.lit(i).alias("item"), F.lit(p).alias("phrase"),
                        F.lit(min(n, V.VALUES_KEPT)).alias("times")) for k, (i, _, p, n) in enumerate(runs)]

    def search(prepared: Column) -> Column:
        numbers = F.filter(
            F.transform(F.filter(F.transform(F.split(prepared, " "), lambda t, i: F.struct(i.alias("i"), t.alias("s"))),
                                 lambda t: F.rlike(t["s"], F.lit("[0-9]"))),
                        lambda t: F.struct(t["i"].alias("i"), parse_amount(t["s"]).alias("v"))),
            lambda n: n["v"].isNotNull())
        present = _present(prepared, entries, [p for _, _, p, _ in runs])

        def collect(hits: Column, nums: Column) -> Column:
            top = F.filter(hits, lambda h: ~F.exists(
                hits, lambda o: (o["phrase"] != h["phrase"]) & F.contains(o["phrase"], h["phrase"])))

            def values(h: Column) -> Column:
                end = F.instr(prepared, h["phrase"]) + F.length(h["phrase"]) - 1
                head = F.substring(prepared, F.lit(1), end)
                index = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))
                glued = parse_amount(F.substring_index(
                    F.substring(prepared, end + 1, F.length(prepared)), " ", 1))
                later = let(index, lambda k: F.transform(
                    F.slice(F.filter(nums, lambda n: n["i"] > k), 1, V.VALUES_KEPT), lambda n: n["v"]))
                once = F.slice(F.concat(F.filter(F.array(glued), lambda v: v.isNotNull()), later), 1, V.VALUES_KEPT)
                return F.flatten(F.array_repeat(once, h["times"]))

            per_phrase = F.transform(top, lambda h: F.struct(h["item"].alias("item"), values(h).alias("vals")))

            def by_item(found: Column) -> Column:
                entries = F.array(*[
                    F.struct(F.lit(name).alias("key"), F.slice(F.flatten(F.transform(
                        F.filter(found, lambda f: f["item"] == i), lambda f: f["vals"])), 1, V.VALUES_KEPT)
                        .alias("value")) for i, name in enumerate(keywords.item_names)])
                return F.map_from_entries(F.transform(
                    F.filter(entries, lambda e: F.size(e["value"]) > 0),
                    lambda e: F.struct(e["key"].alias("key"), F.struct(
                        F.get(e["value"], F.lit(0)).alias("val1"), F.get(e["value"], F.lit(1)).alias("val2"))
                        .alias("value"))))
            return let(per_phrase, by_item)
        none = F.array().cast("array<struct<i:int,v:double>>")
        return let(present, lambda h: let(F.when(F.size(h) > 0, numbers).otherwise(none), lambda n: collect(h, n)))
    return let(F.coalesce(document_form(text), F.lit("")), search)


def two_value_extract(documents: DataFrame, keywords: KeywordSet = CORPORATE, text_col: str = "text") -> DataFrame:
    """Replace the text column by `items`: MAP<item, STRUCT<val1, val2>>."""
    return documents.withColumn("items", two_values(F.col(text_col), keywords)).drop(text_col)


def two_values_long(extracted: DataFrame, items_col: str = "items") -> DataFrame:
    """One row per document and found item, with columns val1 and val2."""
    keep = [c for c in extracted.columns if c != items_col]
    return (extracted.select(*keep, F.explode_outer(items_col).alias("item", "pair")).where(F.col("item").isNotNull())
            .select(*keep, "item", "pair.val1", "pair.val2"))


def parse_documents(documents: DataFrame, custom: KeywordSet | None = None, dialect: str = "service",
                    output_format: str = "text", match: str = "substring") -> DataFrame:
    """Whole document pipeline: keyword choice, year, multiplier, items and the result envelope.

    Input: path STRING, text STRING (an 'Error...' text marks a failed reader), applicant_type STRING,
    file_type STRING, and for `output_format='structured_json'` optionally `structured` (items read from a reply).
    """
    failed = F.coalesce(F.lower(F.substring("text", 1, 5)) == "error", F.lit(False))
    blank, usable = F.coalesce(is_blank(F.col("text")), F.lit(True)), F.col("usable")
    prepared = documents.withColumn("usable", ~failed & ~blank).withColumns({
        "error_parsing": F.when(failed, F.col("text")),
        "detected_year": F.when(usable, report_year(F.col("text"))),
        "detected_multiplier": F.when(usable, unit_multiplier(F.col("text"))).otherwise(F.lit(1.0)),
    })
    multiplier = F.col("detected_multiplier")
    individual = F.col("applicant_type").eqNullSafe("individu")
    if custom is not None:
        items, used = extract_items(F.col("text"), multiplier, custom, dialect, match), F.lit("custom")
    else:
        items = F.when(individual, extract_items(F.col("text"), multiplier, INDIVIDUAL, dialect, match)).otherwise(
            extract_items(F.col("text"), multiplier, CORPORATE, dialect, match))
        used = F.when(individual, F.lit("individual")).otherwise(F.lit("corporate"))
    info = F.concat(
        F.lit("Jenis Pengaju: "), F.coalesce(F.col("applicant_type"), F.lit("korporat")), F.lit(", File Type: "),
        F.coalesce(F.col("file_type"), F.lit("")), F.lit("; Using "), used, F.lit(" keywords"),
        F.when(~usable & F.col("error_parsing").isNull(), F.lit("; Teks yang diekstrak kosong.")).otherwise(F.lit("")))
    extracted = prepared.withColumns({"info_parsing": info, "text_items": F.when(usable, items)})
    common = [base_name(F.col("path")).alias("nama_file"), "info_parsing", "error_parsing"]
    if output_format == "text":
        return extracted.select(
            *common, F.when(usable, F.col("text")).otherwise(F.lit("")).alias("teks_ekstrak_mentah"),
            F.col("detected_year").alias("tahun_pelaporan_terdeteksi"),
            F.col("detected_multiplier").alias("pengali_global_terdeteksi"),
            F.col("text_items").alias("hasil_ekstraksi_kata_kunci"))
    structured = F.col("structured") if "structured" in documents.columns else F.lit(None).cast(f"MAP<STRING, {PAIR}>")
    return extracted.select(
        *common, F.coalesce(structured, F.col("text_items")).alias("hasil_ekstraksi_terstruktur"),
        F.when(structured.isNull(), F.col("detected_year")).alias("tahun_pelaporan_terdeteksi"),
        F.when(structured.isNull(), multiplier).otherwise(F.lit(1.0)).alias("pengali_global_terdeteksi"),
        F.when(structured.isNull() & F.col("text_items").isNull(), F.coalesce(
            F.col("error_parsing"), F.lit("Tidak ada data terstruktur yang dapat dihasilkan."))).alias("error"))


def text_view(parsed: DataFrame) -> DataFrame:
    return parsed.select("nama_file", "teks_ekstrak_mentah", "info_parsing", "error_parsing")


def items_view(parsed: DataFrame) -> DataFrame:
    return parsed.select("nama_file", "tahun_pelaporan_terdeteksi", "pengali_global_terdeteksi", "hasil_ekstraksi_kata_kunci",
                         "error_parsing")
