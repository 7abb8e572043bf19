"""Company statements: canonical item names, map form, period pairs and sub-result views.

Statements live in one row per company and period with `items`: MAP<STRING, STRING or DOUBLE>. A missing key, a null
value and NaN stay three different things.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermill import fixed_values as V
from ledgermill.functions.amounts import to_double
from ledgermill.functions.text import let


def canonical_name(item: Column, aliases: Mapping[str, str] = V.ALIASES) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, item), item)


def canonical_items(line_items: DataFrame, aliases: Mapping[str, str] = V.ALIASES) -> DataFrame:
    """Long form (company, period, item, pos, value): rename aliases, keep the latest entry of each name.

    The partial aggregation runs before the shuffle; the key ends in the item name, so one large company spreads.
    """
    return (line_items.withColumn("item", canonical_name(F.col("item"), aliases))
            .groupBy("company", "period", "item").agg(F.max_by(F.struct("value"), "pos")["value"].alias("value")))


def statements(line_items: DataFrame, aliases: Mapping[str, str] = V.ALIASES) -> DataFrame:
    """Map form of canonical line items: one shuffle on (company, period)."""
    placed = line_items.repartition("company", "period")
    return (canonical_items(placed, aliases).groupBy("company", "period")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", "value")))).alias("items")))


def canonical_map(items: Column, aliases: Mapping[str, str] = V.ALIASES) -> Column:
    """Map form of the renaming; of several entries with one name the last wins. An empty map becomes null."""
    entries = F.transform(F.map_entries(items), lambda e, i: F.struct(
        canonical_name(e["key"], aliases).alias("key"), e["value"].alias("value"), i.alias("pos")))

    def keep_last(es: Column) -> Column:
        # entries are compared with each other only where a name repeats
        repeated = F.size(F.array_distinct(F.transform(es, lambda e: e["key"]))) < F.size(es)
        last = F.when(repeated, F.filter(es, lambda e: ~F.exists(es, lambda o: (o["key"] == e["key"]) & (o["pos"] > e["pos"])))).otherwise(es)
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return F.when(F.size(items) > 0, let(entries, keep_last))


def period_pairs(table: DataFrame, columns: tuple[str, ...] = ("items",), step: int = 1) -> DataFrame:
    """Pair every statement with the one exactly `step` periods earlier, as `<column>_t1` (null if there is none).

    Every row is sent to its own period and, as the earlier one, to a later period; one window on (company, period)
    brings them together. The input is read once, where a self-join would compute it twice, and no key is hot however
    large a company is. Repeated statements of a period all stay; of several earlier ones all rows get the same one, that
    of the largest hash of its values.
    """
    others = [c for c in table.columns if c not in ("company", "period")]

    def role(period: Column, now: bool) -> Column:
        kept = F.struct(*others) if now else F.lit(None)
        old = F.lit(None) if now else F.struct(*columns)
        return F.struct(period.alias("period"), kept.alias("now"), old.alias("old"))
    roles = F.array(role(F.col("period"), True), role(F.col("period") + step, False))
    maps = {f.name for f in table.schema if isinstance(f.dataType, T.MapType)}
    values = F.xxhash64(*[F.map_entries(f"old.{c}") if c in maps else F.col(f"old.{c}") for c in columns])
    paired = table.select("company", F.inline(roles)).withColumn("old", F.max_by(
        "old", F.when(F.col("old").isNotNull(), values)).over(W.partitionBy("company", "period")))
    return paired.where(F.col("now").isNotNull()).select(
        *[c if c in ("company", "period") else F.col(f"now.{c}").alias(c) for c in table.columns],
        *[F.col(f"old.{c}").alias(f"{c}_t1") for c in columns])


class ItemReader:
    """Presence and number of the items of a map column.

    `load` reads all items of one operator in one array expression per row. The per-item expressions are then plain
    array accesses, which keeps the generated code of the long score formulas small enough to be compiled."""

    def __init__(self, items: Column, text: bool, position: Mapping[str, int], numbers: Column,
                 overrides: Mapping[str, Column]):
        self.items, self.text, self.position, self.numbers, self.overrides = items, text, position, numbers, overrides

    @classmethod
    def load(cls, table: DataFrame, column: str, names: Sequence[str],
             overrides: Mapping[str, Column] = {}) -> tuple[DataFrame, "ItemReader"]:
        """The table with one work column, and the reader. An override replaces an existing item's number."""
        text = isinstance(table.schema[column].dataType.valueType, T.StringType)
        unique = list(dict.fromkeys(names))
        work = f"_{column}_numbers"
        loaded = table.withColumn(work, F.transform(
            cls._names(unique), lambda n: to_double(F.col(column)[n]) if text else F.col(column)[n]))
        return loaded, cls(F.col(column), text, {n: k for k, n in enumerate(unique)}, F.col(work), overrides)

    @staticmethod
    def _names(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    def _has(self, name: Column) -> Column:
        return F.coalesce(F.map_contains_key(self.items, name), F.lit(False))

    def number(self, name: str) -> Column:
        plain = F.get(self.numbers, F.lit(self.position[name]))
        if name not in self.overrides:
            return plain
        given = self.overrides[name]
        return F.when(given.isNotNull() & self._has(F.lit(name)), given).otherwise(plain)

    def failed(self, name: str) -> Column:
        """Present but not a number."""
        return self.number(name).isNull() & self._has(F.lit(name))

    def _gaps(self) -> Column:
        """Whether a loaded item has no number; only then are the items looked up by name once more for what is missing or failed."""
        return F.exists(self.numbers, lambda n: n.isNull())

    def first_missing(self, names: Sequence[str]) -> Column:
        return F.when(self._gaps(), F.get(F.filter(self._names(names), lambda n: ~self._has(n)), F.lit(0)))

    def all_missing(self, names: Sequence[str]) -> Column:
        gaps = F.array_join(F.filter(self._names(names), lambda n: ~self._has(n)), ", ")
        return F.when(self._gaps() & (gaps != ""), gaps)

    def first_failed(self, names: Sequence[str]) -> Column:
        """Message for the first item, in the order of the names, that is not a number."""
        entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(self.position[n]).alias("at"),
                                     F.coalesce(self.overrides[n].isNotNull(), F.lit(False)).alias("given")
                                     if n in self.overrides else F.lit(False).alias("given")) for n in names])
        bad = F.filter(entries, lambda e: F.get(self.numbers, e["at"]).isNull() & ~e["given"] & self._has(e["name"]))

        def message(e: Column) -> Column:
            shown = self.items[e["name"]].cast("string")
            return F.coalesce(F.concat(F.lit("could not convert string to float: '"), shown, F.lit("'")),
                              F.concat(F.lit("nilai kosong: "), e["name"]))
        return F.when(self._gaps(), F.get(F.transform(bad, message), F.lit(0)))


def above(value: Column, bound: float | Column) -> Column:
    """value > bound with NaN never above (Spark sorts NaN highest)."""
    return (value > bound) & ~F.isnan(value)


def altman_view(scored: DataFrame) -> DataFrame:
    return scored.select("company", "period", "altman.*")


def beneish_view(scored: DataFrame) -> DataFrame:
    return scored.select("company", "period", "beneish.*")


def ratios_view(scored: DataFrame) -> DataFrame:
    return scored.select("company", "period", "ratios.*")
