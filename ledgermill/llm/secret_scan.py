"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A tokenizer vocabulary of natural text and code packs ordinary words and identifiers into few tokens, several characters
each. Random strings fall apart into tokens of one or two characters. Runs of key characters are encoded, and those with
few characters per token are reported, after known digests and identifiers have been set aside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermill.llm.token_counts import TOKENIZER, encoder

#: Fixed patterns of the three base kinds; matches that fail the length are dropped after the search.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: The token-efficiency test: shortest run, and most characters per token of a random string.
LEAST_RANDOM, MOST_CHARS_PER_TOKEN = 20, 1.9
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RANDOM)
#: Set aside: hex digests of the usual lengths, UUIDs and plain numbers. Words and identifiers pass by the ratio alone.
KNOWN = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
                   r"|[0-9+/=_-]+")
#: The same next to other parts of a run: digests and UUIDs between separators.
KNOWN_PART = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{128}|[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32}"
                        r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9]+")
#: Words with a number at the end; only the words are tested, since long numbers take many tokens.
NUMBERED = re.compile(r"((?:[a-z]+[-_/])+)[0-9]+")
REPLACEMENT = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in the order of start, then kind. The three patterns are searched over the whole text."""
    found = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a match of 24 or more hex digits lies in a run of as many key characters
    for run in RUN.finditer(text):
        found += [(run.start() + m.start(), 2, run.start() + m.end()) for m in HEX.finditer(run[0]) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def _efficient(word: str, path: str, ratio: float) -> bool:
    """Whether a string has more than `ratio` characters per token."""
    return len(word) > ratio * len(encoder(path).encode_ordinary(word))


def _is_random(word: str, path: str, ratio: float) -> bool:
    word = word.strip("=-_/+")
    numbered = NUMBERED.fullmatch(word)
    if numbered:
        word = numbered[1].strip("=-_/+")
    return len(word) >= LEAST_RANDOM and not KNOWN.fullmatch(word) and not _efficient(word, path, ratio)


def _left_over(start: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pieces of start to end outside the cuts, which are disjoint and in order."""
    pieces = []
    for s, e in cuts:
        if s > start:
            pieces.append((start, s))
        start = max(start, e)
    if start < end:
        pieces.append((start, end))
    return pieces


def _random_parts(text: str, start: int, end: int, path: str, ratio: float) -> list[tuple[int, int]]:
    """The random parts of a piece without known spans: what is random between its words, else single parts. A word is a
    part of letters only that is packed well; a secret may itself hold separators."""
    if end - start < LEAST_RANDOM:
        return []
    groups: list[list[tuple[int, int]]] = [[]]
    for part in PART.finditer(text, start, end):
        if part[0].isalpha() and _efficient(part[0], path, ratio):
            groups.append([])
        else:
            groups[-1].append(part.span())
    found = []
    for group in groups:
        if group and _is_random(text[group[0][0]:group[-1][1]], path, ratio):
            found.append((group[0][0], group[-1][1]))
        else:
            found += [(s, e) for s, e in group if _is_random(text[s:e], path, ratio)]
    return found


def random_spans(text: str, base: list[tuple[int, int, int]], path: str = TOKENIZER, ratio: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """What has at most `ratio` characters per token in runs of key characters, outside base spans: what is left of a run as a
    whole, else its parts outside known identifiers."""
    found = []
    cuts: list[tuple[int, int]] = []        # base spans, those that overlap as one
    for s, _, e in base:
        if cuts and s < cuts[-1][1]:
            cuts[-1] = cuts[-1][0], max(cuts[-1][1], e)
        else:
            cuts.append((s, e))
    first = 0
    for run in RUN.finditer(text):
        start, end = run.span()
        while first < len(cuts) and cuts[first][1] <= start:
            first += 1
        last = first
        while last < len(cuts) and cuts[last][0] < end:
            last += 1
        for s, e in _left_over(start, end, [(max(s, start), min(e, end)) for s, e in cuts[first:last]]):
            if _is_random(text[s:e], path, ratio):
                found.append((s, 3, e))
                continue
            known = [m.span() for m in KNOWN_PART.finditer(text, s, e)]
            for a, b in _left_over(s, e, known):
                found += [(x, 3, y) for x, y in _random_parts(text, a, b, path, ratio)]
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """All columns of `docs` with `_base` and `_spans` (arrays of start, end, kind in code points, end exclusive).

    Base spans are never changed; a random span is added where no base span is. Null and empty texts have none. Whole texts
    are searched, one at a time; no shuffle.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("_base", span), T.StructField("_spans", span)])
    at = docs.columns.index(text)
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for value in batch.column(at):
                value = value.as_py() or ""
                first = base_spans(value)
                base.append(first)
                spans.append(sorted(first + random_spans(value, first, path)))
            arrays = [pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in row] for row in rows], arrow) for rows in (base, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "_base", "_spans"])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = find_secrets(docs.select("doc_id", "text"))

    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(name: str, kind: str):
        return F.size(F.filter(name, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count("_base", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined("_base").cast("binary"), 256).alias("base_sha256"), joined("_spans").alias("spans"), count("_spans", "random").alias("n_random"))


def redact(docs: DataFrame, text: str = "text", replacement: str = REPLACEMENT) -> DataFrame:
    """The columns of `docs` with every secret in `text` replaced; of an assignment only the value goes with its name. All rows stay."""
    found = find_secrets(docs, text)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def cut(state, s):
        keep = F.substr(F.col(text), (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        new = F.when(s["start"] >= state["at"], F.concat(state["out"], keep, F.lit(replacement))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), new.alias("out"))
    done = F.aggregate("_spans", start, cut)
    rest = F.substr(F.col(text), (F.col("_done.at") + 1).cast("int"), F.char_length(text))
    clean = F.when(F.size("_spans") > 0, F.concat("_done.out", rest)).otherwise(F.col(text))
    return found.withColumn("_done", done).withColumn(text, clean).select(*docs.columns)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
