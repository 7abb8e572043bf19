"""Keyword sets: corporate, individual and custom."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ledgermill import fixed_values as V

KEYWORD_SCHEMA = "keyword_set STRING, item STRING, item_ord INT, variation STRING, var_ord INT"


@dataclass(frozen=True)
class SplitRule:
    """An item whose numbers stand between a prefix and a suffix phrase (at most `window` characters apart).

    With `exclusive`, the item's own phrase is searched by this rule only."""
    item: str
    prefix: str
    suffix: str
    window: int
    stops: tuple[str, ...]
    exclusive: bool


@dataclass(frozen=True)
class KeywordSet:
    name: str
    items: tuple[tuple[str, tuple[str, ...]], ...]
    split_rules: tuple[SplitRule, ...] = field(default=())

    @property
    def item_names(self) -> list[str]:
        return [item for item, _ in self.items]

    def rows(self) -> list[tuple]:
        return [(self.name, item, i, v, k) for i, (item, vs) in enumerate(self.items) for k, v in enumerate(vs)]

    def phrases(self, longest_first: bool = False) -> list[tuple[int, int, str, int]]:
        """(item_ord, var_ord, lower-cased phrase, times it is repeated in a row)."""
        out: list[tuple[int, int, str, int]] = []
        for i, (_, variations) in enumerate(self.items):
            ordered = sorted(variations, key=len, reverse=True) if longest_first else list(variations)
            for k, phrase in enumerate(v.lower() for v in ordered):
                if out and out[-1][0] == i and out[-1][2] == phrase:
                    out[-1] = (*out[-1][:3], out[-1][3] + 1)
                else:
                    out.append((i, k, phrase, 1))
        return out

    @staticmethod
    def anchors(phrases: Sequence[str]) -> list[tuple[str, list[int]]]:
        """Words that cover the phrases, each with the positions of the phrases that it stands for. A text without the
        word has none of them, so most texts are searched for a dozen words instead of all phrases."""
        left, out = set(range(len(phrases))), []
        while left:
            words: dict[str, set[int]] = {}
            for k in left:
                for word in phrases[k].split(" "):
                    words.setdefault(word, set()).add(k)
            best = max(sorted(words), key=lambda w: (len(words[w]), len(w)))
            out.append((best, sorted(words[best])))
            left -= words[best]
        return out

    def guards(self) -> list[list[str]]:
        """Per item the phrases of all other items; one that contains another listed phrase is redundant."""
        lower = [[v.lower() for v in vs] for _, vs in self.items]
        out = []
        for i in range(len(lower)):
            others = sorted({v for j, vs in enumerate(lower) if j != i for v in vs}, key=len)
            kept: list[str] = []
            for phrase in others:
                if not any(k in phrase for k in kept):
                    kept.append(phrase)
            out.append(kept)
        return out


CORPORATE = KeywordSet("korporat", tuple((item, tuple(ps)) for item, ps in V.CORPORATE_PHRASES))
INDIVIDUAL = KeywordSet("individu", tuple((item, tuple(ps)) for item, ps in V.INDIVIDUAL_PHRASES))


def investing_split_rule(dialect: str) -> SplitRule:
    """The published split-phrase rule for investing cash flow."""
    stops = ("aktivitas operasi",) if dialect == "module" else ("aktivitas operasi", "aktivitas pendanaan")
    return SplitRule(V.INVESTING_CASH, "arus kas bersih yang diperoleh dari", "aktivitas investasi",
                     150 if dialect == "module" else 200, stops, dialect == "module")


def with_operating_cash(keywords: KeywordSet = CORPORATE) -> KeywordSet:
    """The set plus the operating cash flow item that the Beneish score needs."""
    item, phrases = V.OPERATING_CASH_PHRASES
    return KeywordSet(keywords.name, keywords.items + ((item, tuple(phrases)),), keywords.split_rules)


def custom_set(items: Iterable[tuple[str, Sequence[str]]], name: str = "custom",
               split_rules: Sequence[SplitRule] = ()) -> KeywordSet:
    return KeywordSet(name, tuple((i, tuple(vs)) for i, vs in items), tuple(split_rules))


def choose_set(applicant_type: str | None, custom: KeywordSet | None = None) -> KeywordSet:
    """Custom wins, then the individual set for 'individu', else the corporate set."""
    if custom is not None:
        return custom
    return INDIVIDUAL if applicant_type == "individu" else CORPORATE


def keyword_table(spark: SparkSession, *sets: KeywordSet) -> DataFrame:
    return spark.createDataFrame([r for s in sets for r in s.rows()], KEYWORD_SCHEMA)
