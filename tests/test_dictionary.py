"""Phrase dictionaries as tables against the expression form and brute force, and quote-aware records against the csv module."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgermill.functions.text import document_form
from ledgermill.operators import dictionary as D
from ledgermill.operators import extraction as X
from ledgermill.sources.keywords import CORPORATE, KEYWORD_SCHEMA, custom_set, keyword_table
from ledgermill.sources.readers import delimited_text

WORDS = ["aset", "lancar", "laba", "kotor", "beban", "usaha", "jumlah", "1.250", "(300)", "dan", "neto", "a", "b", "rp", "77"]


def random_docs(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", ","]) for _ in range(rng.randint(0, 40)))) for i in range(n)]


ITEMS = [("Aset", ["aset lancar", "jumlah aset", "aset"]), ("Laba", ["laba kotor", "laba dan beban usaha", "laba"]),
         ("Lain", ["a", "b a", "eban us", "jumlah laba kotor neto", "x", "usaha  dobel"]), ("Kosong", ["tidak ada di teks"])]


@pytest.mark.parametrize("dialect", ["module", "service"])
def test_same_as_the_expression_form(spark, dialect):
    keywords = custom_set(ITEMS)
    docs = spark.createDataFrame([*random_docs(120), (120, None), (121, "")], "doc_id long, text string").withColumn("text_id", F.lit(1))
    long = X.items_long(X.annual_extract(docs, keywords, dialect)).where("t IS NOT NULL")
    found = D.dictionary_extract(docs, keyword_table(spark, keywords), dialect=dialect)
    assert found.columns == ["doc_id", "text_id", "item", "t", "t_minus_1"]
    rows = sorted(map(tuple, found.select("doc_id", "item", "t", "t_minus_1").collect()), key=str)
    assert rows == sorted(map(tuple, long.select("doc_id", "item", "t", "t_minus_1").collect()), key=str) and len(rows) > 100


def test_corporate_set_and_plan(spark):
    texts = [(i, f"Neraca {v} 12.500 11.000 catatan {CORPORATE.items[(i * 5) % len(CORPORATE.items)][1][0]} (7.000)")
             for i, (_, vs) in enumerate(CORPORATE.items) for v in vs[:2]]
    docs = spark.createDataFrame(texts, "doc_id long, text string").dropDuplicates(["doc_id"])
    table = keyword_table(spark, CORPORATE)
    found = D.dictionary_extract(docs, table)
    long = X.items_long(X.annual_extract(docs)).where("t IS NOT NULL")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, long.collect()), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert CORPORATE.items[3][1][0].lower() not in plan             # phrases are data


def test_hundred_thousand_phrases(spark):
    rng = random.Random(5)
    letters = "abcdefghij"

    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    phrases = {" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(100_000)}
    texts = [(i, " ".join(word() for _ in range(80)).upper()) for i in range(40)]
    planted = sorted(p for p in phrases if " " in p)[:30]
    texts += [(100 + i, f"lead x{p}y\ntail") for i, p in enumerate(planted)] + [(100, "again"), (None, f"null key {planted[0]}"), (7, planted[1])]
    table = spark.createDataFrame([(f"i{n % 1000}", n % 1000, p, n) for n, p in enumerate(sorted(phrases))], "item string, item_ord int, variation string, var_ord int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(((r.doc_id, r.phrase, r.position) for r in D.dictionary_matches(docs, table).collect()), key=str)
    forms = [(r.doc_id, r.f) for r in docs.select("doc_id", document_form(F.col("text")).alias("f")).collect()]
    by_item = {(f"i{n % 1000}", p) for n, p in enumerate(sorted(phrases))}
    assert found == sorted(((i, p, f.index(p) + 1) for i, f in forms for _, p in by_item if p in f), key=str)
    index = D.phrase_index(table)
    assert index.count() == len(by_item) and len(D.key_kinds(index)) <= 15


def test_sent_index_is_the_joined_index(spark, monkeypatch):
    """An index of bounded size is looked up in the tasks, without a join of all keys of all texts; the phrases are the same."""
    phrases = [*[p for _, ps in ITEMS for p in ps], "a ", " b", "ket", "é", "", None, "lab"]
    table = spark.createDataFrame([(f"i{n % 4}", n % 4, p, n) for n, p in enumerate(phrases)], "item string, item_ord int, variation string, var_ord int")
    docs = spark.createDataFrame([*random_docs(80, 9), (7, "ASET  lancar"), (None, "laba é kotor"), (90, None), (91, "")], "doc_id long, text string")

    def found():
        rows = D.phrases_in(docs, table)
        return rows, sorted(map(str, rows.select("doc_id", "_form", "_present").collect()))
    sent, result = found()
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(D, "REMEMBERED_WORDS", 3)
    assert found()[1] == result
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    joined, expected = found()
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString() and result == expected


@pytest.mark.parametrize("few, remembered", [(64, 200_000), (0, 200_000), (0, 2)])
def test_keys_held_by_a_text_are_found_for_every_kind(monkeypatch, few, remembered):
    """Keys are cut out of a text at once, not letter by letter of each word that no text had before; none that the text holds is lost."""
    monkeypatch.setattr(D, "FEW_KEYS", few)
    monkeypatch.setattr(D, "REMEMBERED_WORDS", remembered)
    rng, kinds = random.Random(8), {}
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))) for _ in range(150)] + [""]
    memory = {}
    for form in texts:
        words, pairs = form.split(" "), list(zip(form.split(" "), [*form.split(" ")[1:], ""]))
        held = {"w1": set(words) - {""}, "w2": {f"{a} {b}" for a, b in pairs if b}}
        held |= {f"b{j}{l}": {f"{a[len(a) - j:]} {b[:l]}" for a, b in pairs if len(a) >= j and len(b) >= l and b} for j in range(4) for l in range(4)}
        held |= {f"c{q}": {w[i:i + q] for w in words for i in range(len(w) - q + 1)} for q in range(1, 5)}
        for kind, expected in held.items():
            kinds.setdefault(kind, {}).update(dict.fromkeys(expected, [0]))
        for kind, expected in held.items():             # the keys of all texts so far
            found = set(D._keys_held(form, words, kind, kinds[kind], memory.setdefault((kind, len(kinds[kind])), {})))
            assert found == expected & kinds[kind].keys(), (form, kind)


def finder(phrases):
    """A finder of phrases, which may repeat, and its rows."""
    table = sorted((n % 3, f"i{n % 3}", n, p) for n, p in enumerate(phrases))
    words = [p.split(" ") for *_, p in table]
    keys = [f"c{min(len(w[0]), 4)}:{w[0][:4]}" if len(w) == 1 else f"b{min(len(w[0]), 3)}{min(len(w[1]), 3)}:{w[0][-3:]} {w[1][:3]}" for w in words]
    return D.PhraseFinder([(*row, key) for row, key in zip(table, keys)], StructType.fromDDL("item_ord int, item string, var_ord int, phrase string")), table


@pytest.mark.parametrize("chunk, dense", [(256 * 1024, 4), (64, 4), (7, 100), (1, 100), (64, -1)])
def test_all_phrases_are_found_at_once(monkeypatch, chunk, dense):
    """Phrases of every length, at the ends of texts, across blocks, with letters of several bytes and in several items; dense texts too."""
    monkeypatch.setattr(D, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(D, "DENSE", dense)
    rng = random.Random(4)

    def text(words):
        return " ".join("".join(rng.choice("abé漢😀") for _ in range(rng.randint(1, 5))) for _ in range(words))
    texts = ["", *[text(rng.randint(1, 25)) for _ in range(60)], "", "a", "a" * 300, ""]
    phrases = [t[i:i + rng.randint(1, 30)] for t in texts for i in rng.sample(range(len(t)), min(len(t), 6))] + [text(2) for _ in range(40)]
    phrases = [p for p in phrases if "" not in p.split(" ")] + [texts[1], texts[1] + "a", "aaaaaaaab", "a" * 300, "a" * 301, "b"]
    search, table = finder([*phrases, *phrases[:50]])
    forms = pa.array(["left out", *texts])[1:]
    found = [tuple(map(int, row)) for part in search.find(forms) for row in zip(*part)]
    assert found == [(n, i, t.index(row[3]) + 1) for n, t in enumerate(texts) for i, row in enumerate(table) if row[3] in t]
    assert len(found) > 1000 and list(finder([])[0].find(forms)) == list(search.find(pa.array([], pa.string()))) == []


def test_only_dense_texts_are_searched_one_by_one(monkeypatch):
    """The letters of a text are not looked at once for every phrase or key; one letter over and over is the exception."""
    single = []
    monkeypatch.setattr(D, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(D.PhraseFinder, "_one_by_one", lambda self, data, ends, f=D.PhraseFinder._one_by_one: single.append(len(data)) or f(self, data, ends))
    usual = [" ".join(random.Random(n).choices(WORDS, k=50)) for n in range(20)]
    search, table = finder(["a" * n for n in range(8, 100)] + WORDS)
    found = [tuple(map(int, row)) for part in search.find(pa.array([*usual, "a" * 900])) for row in zip(*part)]
    assert len(single) == 1 and len(found) == sum(row[3] in t for t in [*usual, "a" * 900] for row in table)


def test_matches_come_from_the_tasks_as_rows(spark, monkeypatch):
    """Positions are those of the search: neither texts nor lists of phrases come back from the tasks, to be searched once more."""
    phrases = [p for _, ps in ITEMS for p in ps]
    table = spark.createDataFrame([(f"i{n % 4}", n % 4, p, n) for n, p in enumerate(phrases)], "item string, item_ord int, variation string, var_ord int")
    docs = spark.createDataFrame([*random_docs(80, 9), (7, "ASET  lancar"), (None, "É laba\tkotor"), (None, "laba"), (90, None), (91, "")], "doc_id long, text string")
    sent = D.dictionary_matches(docs, table)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "instr" not in plan and "Generate" not in plan and "Exchange" not in plan
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    joined = D.dictionary_matches(docs, table)
    assert "instr" in joined._jdf.queryExecution().executedPlan().toString() and sent.schema == joined.schema
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect())) and sent.count() > 100


def test_empty_dictionary_and_odd_phrases(spark):
    docs = spark.createDataFrame([(1, "satu dua 5")], "doc_id long, text string")
    none = spark.createDataFrame([], KEYWORD_SCHEMA)
    assert D.dictionary_matches(docs, none).count() == 0 and D.dictionary_extract(docs, none).count() == 0
    odd = spark.createDataFrame([("s", "A", 0, "", 0), ("s", "A", 0, None, 1), ("s", "B", 1, "DUA ", 0), ("s", "C", 2, " dua", 0), ("s", "D", 3, r"\E", 0)], KEYWORD_SCHEMA)
    assert sorted((r.item, r.position) for r in D.dictionary_matches(docs, odd).collect()) == [("B", 6), ("C", 5)]


def csv_text(content):
    """The csv module's rows in the printed form."""
    csv.field_size_limit(10**7)
    rows = [r for r in csv.reader(io.StringIO(content, newline="")) if r != []]
    if not rows:
        return "Error CSV: Berkas kosong"
    if any(len(r) > len(rows[0]) for r in rows):
        return "Error CSV: jumlah kolom tidak sama"
    return "\n".join("\t".join([c or "nan" for c in r] + ["nan"] * (len(rows[0]) - len(r))) for r in rows)


def test_records_with_quoted_line_breaks(spark):
    rng, cases = random.Random(11), ['"a\nb",c', '"a""b"\n1', 'x"y,z\n1,2', '"a"b,c', ',\n', '""\n1', '"' + "long ,\n" * 20_000 + '",2\n3,4']
    for _ in range(400):
        cells = ['"' + "".join(rng.choice(['a', ',', '\n', '\r\n', '""', ' ']) for _ in range(rng.randint(0, 5))) + '"' if rng.random() < 0.5
                 else "".join(rng.choice(['b', '1', ' ', '.']) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 12))]
        cases.append("".join(c + rng.choice([",", ",", "\n", "\r\n", "\n\n"]) for c in cells))
    table = spark.createDataFrame(list(enumerate(cases)), "i int, content string")
    found = {r.i: r.t for r in table.select("i", delimited_text(F.col("content")).alias("t")).collect()}
    assert {i: found[i] for i in range(len(cases)) if found[i] != csv_text(cases[i])} == {}
    opened = spark.createDataFrame([('a,"b\nc',), ('"a""\n',), ('a,b\n"',)], "content string")
    assert {r[0] for r in opened.select(delimited_text(F.col("content"))).collect()} == {"Error CSV: tanda kutip tidak ditutup"}
