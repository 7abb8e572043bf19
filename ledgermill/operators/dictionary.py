"""Large phrase dictionaries: phrases as a table, found by an n-gram index joined by equality.

A phrase table is turned into index rows, one per phrase: a key that every text with the phrase must hold. Phrases may begin
and end inside a word, so only their inner words are whole words of the text. Kinds of keys:

- `w2`, `w1`: two words, or one word, between the first and the last word of the phrase;
- `b<j><l>`: the last j letters of a word, a blank and the first l letters of the next (j and l up to 3);
- `c<q>`: the first q letters of a phrase of one word (q up to 4).

Of the keys that a phrase could have it gets the one that makes the fewest candidates: the phrases of the dictionary that share it,
times its chance in a text, a quarter for each letter. A text gives the keys of
those kinds that the dictionary uses; equal keys make a candidate, and the text itself decides whether it holds the phrase.

An index of bounded size goes to every task, which looks for all its phrases at once in the bytes of an Arrow batch of texts: every phrase
has an anchor, some of its bytes that few phrases share; all places of the texts are looked up by anchor in a few passes, and the bytes of the
text decide. A larger index is joined to the keys of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermill.functions.text import document_form, let
from ledgermill.operators.extraction import phrase_windows, window_values
from ledgermill.session import materialise

_EDGE, _GRAM = 3, 4
#: An index of at most so many bytes of strings is sent to the tasks, so that the keys of the texts need no rows of their own.
BROADCAST_BYTES = 8 * 1024 * 1024
#: So many first letters of phrases of one word are each searched in a text; of more, the words of the text are looked up.
FEW_KEYS = 64
#: A task remembers what first letters so many words hold.
REMEMBERED_WORDS = 200_000
#: So many bytes of texts are searched at once, at least one text.
CHUNK_BYTES = 256 * 1024
#: Texts that have more candidates than so many for each of these bytes, as of one letter over and over, are searched one by one.
DENSE = 4
#: So many found phrases leave a task at once.
FOUND_ROWS = 100_000


def _pairs(words: Column) -> Column:
    """Neighbouring words as structs (a, b)."""
    return F.arrays_zip(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))).alias("a"),
                        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def _key(kind: str | Column, text: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), text)


def phrase_index(dictionary: DataFrame) -> DataFrame:
    """item, item_ord, var_ord, phrase, key of (item, item_ord, variation, var_ord): one row per item and distinct phrase, in lower
    case. Empty phrases and null ones are left out. Two aggregates over the dictionary, no pass over its rows on the driver."""
    phrases = (dictionary.where("item IS NOT NULL AND variation <> ''").withColumn("phrase", F.lower("variation"))
               .groupBy("item", "item_ord", "phrase").agg(F.min("var_ord").alias("var_ord")))
    words = F.split("phrase", " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))

    def edge(p: Column) -> Column:
        j, l = F.least(F.char_length(p["a"]), F.lit(_EDGE)), F.least(F.char_length(p["b"]), F.lit(_EDGE))
        return _key(F.concat(F.lit("b"), j.cast("string"), l.cast("string")), F.concat(F.right(p["a"], j), F.lit(" "), F.left(p["b"], l)))
    size = F.least(F.char_length("phrase"), F.lit(_GRAM))
    possible = F.when(F.size(words) == 1, F.array(_key(F.concat(F.lit("c"), size.cast("string")), F.left("phrase", size)))).otherwise(
        F.concat(F.transform(_pairs(inner), lambda p: _key("w2", F.concat(p["a"], F.lit(" "), p["b"]))),
                 F.transform(inner, lambda w: _key("w1", w)), F.transform(_pairs(words), edge)))
    keyed = phrases.withColumn("key", F.explode(F.array_distinct(possible)))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("sharing"))
    candidates = (F.log2("sharing") - 2 * F.char_length("key")).alias("candidates")
    best = keyed.join(shared, "key").groupBy("item", "item_ord", "phrase", "var_ord").agg(F.min(F.struct(candidates, "key")).alias("best"))
    return best.select("item", "item_ord", "var_ord", "phrase", "best.key")


def key_kinds(index: DataFrame) -> dict[str, int]:
    """The kinds of keys in use, 15 at most, and how many bytes of strings the index rows of each hold."""
    size = F.octet_length("key") + F.octet_length("phrase") + F.octet_length("item")
    return {r[0]: r[1] for r in index.groupBy(F.substring_index("key", ":", 1)).agg(F.sum(size)).collect()}


def text_keys(forms: DataFrame, form: str, kinds: Iterable[str]) -> DataFrame:
    """The columns of `forms` but the text in document form, and `key`: the keys of these kinds that the text holds. One key may come
    several times. A row per word and its next one comes first, so that keys are made in generated code."""
    def pair(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit(" "), F.coalesce(b, F.lit("")))
    pairs = let(F.split(form, " "), lambda w: F.array_distinct(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), pair)))
    # outer: a plain explode makes the optimizer evaluate the array once more in a filter below it
    rows = forms.select(*[c for c in forms.columns if c != form], F.explode_outer(pairs).alias("_pair"))
    a, b = F.substring_index("_pair", " ", 1), F.substring_index("_pair", " ", -1)
    none = F.array().cast("array<string>")

    def within(kind: str, size: int) -> Column:
        """The keys of every `size` letters in a row of a word."""
        return F.when(F.char_length(a) >= size, F.transform(
            F.sequence(F.lit(1), F.char_length(a) - size + 1), lambda i: _key(kind, F.substr(a, i, F.lit(size))))).otherwise(none)
    single, grams = [], []
    for kind in sorted(kinds):
        if kind == "w1":
            single.append(_key("w1", a))
        elif kind == "w2":
            single.append(_key("w2", F.col("_pair")))
        elif kind[0] == "b":
            j, l = int(kind[1]), int(kind[2])       # a shorter word makes a shorter key, which no phrase has
            single.append(_key(kind, F.concat(F.substring(a, -j, j), F.lit(" "), F.substring(b, 1, l))))
        else:
            grams.append(within(kind, int(kind[1])))
    parts = ([F.array(*single)] if single else []) + grams
    every = F.concat(*parts) if parts else none
    return rows.select(*[c for c in rows.columns if c != "_pair"], F.explode_outer(every).alias("key")).where("key IS NOT NULL")


def _by_kind(rows: list[tuple]) -> dict[str, dict[str, list[int]]]:
    """Index rows (the key last) by the kind and the text of their keys, each with the numbers of its rows."""
    out: dict[str, dict[str, list[int]]] = {}
    for i, row in enumerate(rows):
        kind, part = row[-1].split(":", 1)
        out.setdefault(kind, {}).setdefault(part, []).append(i)
    return out


def _keys_held(form: str, words: list[str], kind: str, keys: dict[str, list[int]], known: dict[str, tuple]) -> Iterable[str]:
    """The keys of one kind that a text in document form, and its words, hold. Whatever of that kind the text has is cut out and looked up at
    once; only first letters of phrases, if there are many, are looked for in every word, and what a word holds is remembered."""
    if kind == "w1":
        return keys.keys() & set(words)
    if kind == "w2":
        return keys.keys() & set(map(" ".join, zip(words, words[1:])))
    size = int(kind[1])
    if kind[0] == "b":                                  # the last letters of a word end in front of a blank, others follow it
        behind = 1 + int(kind[2])
        blanks = accumulate(map(len, words[:-1]), lambda at, n: at + 1 + n)
        return keys.keys() & {form[max(at - size, 0):at + behind] for at in blanks}
    if len(keys) <= FEW_KEYS:
        return [k for k in keys if k in form]
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    own = set(words)
    for word in own - known.keys():
        known[word] = tuple(keys.keys() & {word[i:i + size] for i in range(len(word) - size + 1)})
    return {k for word in own for k in known[word]}


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes from every place of bytes with seven more behind, as numbers, without a copy."""
    return np.ndarray(len(data) - 7, f"<u{size}", data, strides=(1,))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _first(keys: np.ndarray) -> np.ndarray:
    """Where each key comes first."""
    codes = pa.array(keys).dictionary_encode().indices.to_numpy()          # numbered as they come
    return np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))


class _Anchors:
    """Phrases of one class of length by their anchors: of all their windows of `size` bytes the one that fewest phrases share and whose halves
    are rare in the dictionary. A table says which windows of a text may be one."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, phrases: np.ndarray, size: int) -> None:
        self.size, count = size, sizes[phrases] - size + 1
        places, owner = _ranges(starts[phrases], count), np.repeat(phrases, count)
        values = _windows(data, size)[places]
        _, same, sharing = np.unique(values, return_inverse=True, return_counts=True)
        score = np.log2(sharing)[same]
        if size > 1:
            _, same, often = np.unique(_windows(data, size // 2), return_inverse=True, return_counts=True)
            common = np.log2(often)[same]
            score += sum(common[places + i] for i in range(size // 2 + 1))
        order = np.lexsort((score, owner))
        best = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        best = best[np.argsort(values[best], kind="stable")]
        self.values, first, self.counts = np.unique(values[best], return_index=True, return_counts=True)
        self.firsts, self.phrases, self.offsets = first, owner[best], places[best] - starts[owner[best]]
        self.bits = 8 * size if size < 4 else max(16, min(22, len(self.values).bit_length() + 6))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.slots(self.values)] = True

    def slots(self, windows: np.ndarray) -> np.ndarray:
        if self.size < 4:
            return windows
        odd = windows.dtype.type(0x9E3779B1 if self.size == 4 else 0x9E3779B97F4A7C15)
        return (windows * odd) >> windows.dtype.type(8 * self.size - self.bits)

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that hold an anchor, in order, and the number of its value."""
        places = np.flatnonzero(self.table[self.slots(windows)])
        held = windows[places]
        which = np.minimum(np.searchsorted(self.values, held), len(self.values) - 1)
        true = self.values[which] == held
        return places[true], which[true]


class PhraseFinder:
    """Finds all phrases of the rows (item_ord, item, var_ord, phrase, key) of an index in many texts at once."""

    def __init__(self, rows: list[tuple], schema: T.StructType) -> None:
        self.rows, self.kinds = rows, None
        types = [{"int": pa.int32(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.string()) for f in schema]
        self.columns = {f.name: pa.array([row[k] for row in rows], t) for k, (f, t) in enumerate(zip(schema, types))}
        distinct: dict[str, int] = {}
        owner = np.array([distinct.setdefault(row[3], len(distinct)) for row in rows], np.int64)
        self.by_phrase, self.copies = np.argsort(owner, kind="stable"), np.bincount(owner, minlength=len(distinct))
        encoded = [p.encode() for p in distinct]
        self.sizes = np.array([len(p) for p in encoded], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(encoded) + bytes(7), np.uint8)
        size = np.minimum(1 << np.log2(self.sizes).astype(np.int64), 8)
        self.anchors = [_Anchors(self.data, self.starts, self.sizes, np.flatnonzero(size == s), s) for s in np.unique(size).tolist()]

    def _block(self, data: np.ndarray, ends: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray] | None:
        """text x phrases + phrase and the first place, from `start` to `stop`, of each phrase that a text holds; None if candidates are dense.
        `ends` are the places where texts begin, and the end of the last one."""
        found = []
        own, held = _windows(self.data, 8), _windows(data, 8)
        masks = np.array([0] + [(1 << 8 * n) - 1 for n in range(1, 9)], np.uint64)
        for anchor in self.anchors:
            places, which = anchor.candidates(_windows(data, anchor.size)[start:stop])
            counts = anchor.counts[which]
            if counts.sum() > DENSE * CHUNK_BYTES:
                return None
            texts = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(places, ends - start)))
            entry = _ranges(anchor.firsts[which], counts)
            phrase, text = anchor.phrases[entry], np.repeat(texts, counts)
            at = np.repeat(places + start, counts) - anchor.offsets[entry]
            true = np.flatnonzero((at >= ends[text]) & (at + self.sizes[phrase] <= ends[text + 1]))
            phrase, text, at = phrase[true], text[true], at[true]
            for step in range(0, int(self.sizes.max()), 8):         # eight bytes after eight, the last eight from the end
                left = np.flatnonzero(self.sizes[phrase] > step)
                if not len(left):
                    break
                size = self.sizes[phrase[left]]
                shift = np.minimum(step, np.maximum(size - 8, 0))
                differ = (held[at[left] + shift] ^ own[self.starts[phrase[left]] + shift]) & masks[np.minimum(size, 8)]
                true = np.ones(len(at), bool)
                true[left[differ != 0]] = False
                phrase, text, at = phrase[true], text[true], at[true]
            keys = text * len(self.sizes) + phrase
            first = _first(keys)
            found.append((keys[first], at[first]))
        return np.concatenate([k for k, _ in found]), np.concatenate([at for _, at in found])

    def _one_by_one(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """As `_chunk`, by the keys of each text."""
        if self.kinds is None:
            self.kinds = [(kind, keys, {}) for kind, keys in _by_kind(self.rows).items()]
        found = []
        for n, (start, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            form = data[start:end].tobytes().decode()
            words = form.split(" ")
            possible = {i for kind, keys, known in self.kinds for key in _keys_held(form, words, kind, keys, known) for i in keys[key]}
            found += [(n, i, at) for i in sorted(possible) if (at := form.find(self.rows[i][3]) + 1)]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def _chunk(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number of the text, number of the row and position, from 1 and in letters, of all that the texts hold, in this order."""
        found = []
        for start in range(0, int(ends[-1]), CHUNK_BYTES):
            block = self._block(data, ends, start, min(start + CHUNK_BYTES, int(ends[-1])))
            if block is None:
                return self._one_by_one(data, ends)
            found.append(block)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        keys, at = (np.concatenate(part) for part in zip(*found))
        if len(found) > 1:                              # a text of several blocks
            first = _first(keys)
            keys, at = keys[first], at[first]
        text, phrase = np.divmod(keys, len(self.sizes))
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])       # other bytes go on with a letter
        position = letters[at] - letters[ends[text]] + 1
        copies = self.copies[phrase]
        row = self.by_phrase[_ranges((np.cumsum(self.copies) - self.copies)[phrase], copies)]
        text, position = np.repeat(text, copies), np.repeat(position, copies)
        order = np.argsort(text * len(self.rows) + row)
        return text[order], row[order], position[order]

    def find(self, forms: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """Number of the text, number of the row and position of what the texts of a batch hold, some texts at a time."""
        if not self.rows or not len(forms):
            return
        forms = forms.cast(pa.large_binary())
        _, places, data = forms.buffers()
        ends = np.frombuffer(places, np.int64)[forms.offset:forms.offset + len(forms) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        first = 0
        while first < len(forms):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_BYTES, "right")) - 1)
            part = np.concatenate([data[ends[first]:ends[last]], np.zeros(7, np.uint8)])
            text, row, position = self._chunk(part, ends[first:last + 1] - ends[first])
            yield text + first, row, position
            first = last


def _sent_finder(index: DataFrame) -> tuple[Broadcast, T.StructType]:
    """The finder of an index of bounded size, sent to the tasks, and the type of its entries."""
    entry = index.select("item_ord", "item", "var_ord", "phrase").schema
    rows = [tuple(r) for r in index.select(*entry.names, "key").orderBy(*entry.names).collect()]
    return index.sparkSession.sparkContext.broadcast(PhraseFinder(rows, entry)), entry


def _phrase_search(index: DataFrame) -> Callable[[Column], Column]:
    """For an index of bounded size, a function of a text in document form: its phrases as in `phrases_in`."""
    sent, entry = _sent_finder(index)
    names = entry.names

    def search(forms: pa.Array) -> pa.Array:
        finder, found, counts = sent.value, [np.zeros(0, np.int64)], np.zeros(len(forms), np.int64)
        for text, row, _ in finder.find(forms):
            found.append(row)
            counts += np.bincount(text, minlength=len(forms))
        entries = pa.StructArray.from_arrays([finder.columns[n] for n in names], names=names)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries.take(pa.array(np.concatenate(found))))
    return F.arrow_udf(search, T.ArrayType(entry))


def _document_forms(documents: DataFrame, text: str) -> DataFrame:
    return documents.withColumn("_form", F.coalesce(document_form(F.col(text)), F.lit(""))).drop(text)


def _phrase_rows(forms: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """For an index of bounded size, key, item, phrase, position of every phrase that stands in a text: rows come from the tasks as they are, no
    text comes back and no position is looked for once more."""
    sent, entry = _sent_finder(index)
    forms = forms.select(key, "_form")
    schema = T.StructType([forms.schema[0], T.StructField("item", entry["item"].dataType), T.StructField("phrase", entry["phrase"].dataType),
                           T.StructField("position", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = sent.value
        for batch in batches:
            for found in finder.find(batch.column(1)):
                for start in range(0, len(found[0]), FOUND_ROWS):
                    text, row, position = (pa.array(part[start:start + FOUND_ROWS]) for part in found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(text), finder.columns["item"].take(row), finder.columns["phrase"].take(row),
                                                      position], names=schema.names)
    return forms.mapInArrow(search, schema)


def _searched_index(dictionary: DataFrame) -> tuple[DataFrame, dict[str, int], bool]:
    """The index, read twice: for its kinds, which are given too, and for the search; and if it is sent to the tasks."""
    index = materialise(phrase_index(dictionary))
    kinds = key_kinds(index)
    return index, kinds, sum(kinds.values()) <= BROADCAST_BYTES


def _joined_phrases(forms: DataFrame, key: str, index: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """`forms` with `_present`, as in `phrases_in`, by a join of keys."""
    keys = text_keys(forms.select(F.col(key).alias("_doc"), "_form"), "_form", kinds)
    # a text has its frequent keys many times: hashed away on the map side, before anything is collected
    found = keys.join(index.hint("shuffle_hash"), "key").select("_doc", "item_ord", "item", "var_ord", "phrase").distinct()
    candidates = found.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("item_ord", "item", "var_ord", "phrase"))).alias("_possible"))
    joined = forms.join(candidates, forms[key].eqNullSafe(candidates["_doc"]), "left").drop("_doc")
    none = F.array().cast("array<struct<item_ord:int,item:string,var_ord:int,phrase:string>>")
    present = F.filter(F.coalesce("_possible", none), lambda p: F.contains(F.col("_form"), p["phrase"]))
    return joined.withColumn("_present", present).drop("_possible")


def phrases_in(documents: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `documents` but the text, with `_form` (the text in document form) and `_present`: the phrases that stand in
    it as structs (item_ord, item, var_ord, phrase), in that order; documents without any have an empty array.

    An index is sent to the tasks up to a size, which is measured, and no text is shuffled; beyond, keys and phrases are joined by
    equality and both sides are shuffled. Rows that repeat a key are searched each by their own text; a null key is a key. A key that
    many texts and many phrases share makes as many candidates; the choice of rare keys keeps them few.
    """
    index, kinds, sent = _searched_index(dictionary)
    forms = _document_forms(documents, text)
    return forms.withColumn("_present", _phrase_search(index)("_form")) if sent else _joined_phrases(forms, key, index, kinds)


def dictionary_matches(documents: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item, phrase, position (of the first occurrence, from 1) of every phrase that stands in a text."""
    index, kinds, sent = _searched_index(dictionary)
    forms = _document_forms(documents.select(key, text), text)
    if sent:
        return _phrase_rows(forms, key, index)
    rows = _joined_phrases(forms, key, index, kinds)
    # outer: a plain inline makes the optimizer search the text once more in a filter below it
    return rows.select(key, "_form", F.inline_outer("_present")).where("phrase IS NOT NULL").select(
        key, "item", "phrase", F.instr(F.col("_form"), F.col("phrase")).cast("bigint").alias("position"))


def dictionary_extract(documents: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", dialect: str = "module",
                       multiplier: Column | None = None) -> DataFrame:
    """The columns of `documents` but the text, item, t, t_minus_1: the items of a phrase table that have an amount.

    Same rules as `annual_extract` on a keyword set: phrases count in the order of their item and spelling (the service
    dialect takes long spellings first), the first occurrence with an amount decides, and a phrase of another item before
    an amount ends the search. The items are rows, as a dictionary may have any number.
    """
    rows = phrases_in(documents, dictionary, key, text)
    scale = F.lit(1.0) if multiplier is None else multiplier

    def order(p: Column) -> Column:
        first = -F.char_length(p["phrase"]) if dialect == "service" else F.lit(0)
        return F.struct(p["item_ord"].alias("item_ord"), first.alias("first"), p["var_ord"].alias("var_ord"), p["item"].alias("item"), p["phrase"].alias("phrase"))

    def search(present: Column) -> Column:
        guarded = F.transform(present, lambda p: F.struct(p["item"].alias("item"), p["phrase"].alias("phrase"), F.transform(
            F.filter(present, lambda o: o["item_ord"] != p["item_ord"]), lambda o: o["phrase"]).alias("guards")))
        windows = F.flatten(F.transform(guarded, lambda p: F.transform(
            phrase_windows(F.col("_form"), p["phrase"], dialect),
            lambda w: F.struct(p["item"].alias("item"), window_values(w, p["guards"], dialect).alias("vals")))))
        return let(F.filter(windows, lambda h: F.size(h["vals"]) > 0), lambda hits: F.transform(
            F.array_distinct(F.transform(hits, lambda h: h["item"])), lambda name: let(
                F.get(F.filter(hits, lambda h: h["item"] == name), F.lit(0))["vals"], lambda v: F.struct(
                    name.alias("item"), (F.get(v, F.lit(0)) * scale).alias("t"), (F.get(v, F.lit(1)) * scale).alias("t_minus_1")))))
    found = let(F.array_sort(F.transform("_present", order)), search)
    keep = [c for c in documents.columns if c != text]
    return rows.select(*keep, F.inline_outer(found).alias("item", "t", "t_minus_1")).where(F.col("item").isNotNull())

