import pytest
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions import replies, text as T
from ledgermill.functions.amounts import maybe_numeric, parse_amount, to_double
from ledgermill.functions.headers import report_year, unit_multiplier
from ledgermill.operators import extraction as X, layout as L, narrative as N
from ledgermill.operators.outlook import sector_outlook
from ledgermill.operators.spatial import SEQ_CHUNK, spatial_extract
from ledgermill.sources.keywords import CORPORATE, INDIVIDUAL, choose_set, custom_set, investing_split_rule, with_operating_cash

AMOUNTS = [
    ("Rp1.234.567,89", 1234567.89, 1234567.89), ("1,234.56", 1234.56, 1234.56), ("1.234", 1234.0, 1234.0),
    ("(1.234)", -1234.0, -1234.0), ("-5,5", -5.5, -55.0), ("1,234.567.890", None, 1234567890.0), ("catatan12", 12.0, 12.0),
    ("12,3", 12.3, 123.0), ("19,238", 19238.0, 19238.0), ("123.45", 123.45, 123.45), ("(1.234", 1.234, 1.234),
    ("1,2345", 1.2345, 1.2345), ("lancar", None, None), (".", None, None), ("-", None, None), ("2023", 2023.0, 2023.0),
    ("(-5)", -5.0, -5.0), ("", None, None), (None, None, None), ("1.500 ribu", 1500.0, 1500.0), ("()", None, None)]


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("dialect, column", [("module", 1), ("service", 2)])
def test_amount_dialects(spark, dialect, column):
    assert apply(spark, lambda c: parse_amount(c, dialect), [a[0] for a in AMOUNTS]) == [a[column] for a in AMOUNTS]


def test_float_reading(spark):
    values = ["12d", " 1_000 ", "1e3", ".5", "5.", "", "1,0", "inf", "NaN", "+7", "1__0", "0x1"]
    out = apply(spark, to_double, values)
    expected = []
    for v in values:
        try:
            expected.append(float(v))
        except ValueError:
            expected.append(None)
    assert [str(o) for o in out] == [str(e) for e in expected]


def test_numeric_guard(spark):
    assert apply(spark, maybe_numeric, ["12", "Rp12", "abc12", "USD100", "x", "EU12R"]) == [True, True, False, False, False, True]


def test_years_and_units(spark):
    texts = ["untuk tahun yang berakhir 31 Desember 2023", "tahun buku 2022, dan 2031%", "Rp2024 2.025 1999", "per 30 juni 2021.",
             "nilai 2024,5 dan 12.2045", "", None, "2010 2012 2011"]
    assert apply(spark, report_year, texts) == ["2023", "2022", None, "2021", "2045", None, None, "2012"]
    units = ["(Dinyatakan dalam jutaan Rupiah)", "DALAM RIBUAN", "Disajikan dalam miliar", "dinyatakan triliun", "x" * 1000 + "dalam juta", ""]
    assert apply(spark, unit_multiplier, units) == [1e6, 1e3, 1e9, 1e12, 1.0, 1.0]


def extract(spark, text, **options):
    rows = spark.createDataFrame([(text,)], "text string")
    multiplier = unit_multiplier(F.col("text")) if options.pop("scaled", False) else None
    out = X.annual_extract(rows, multiplier=multiplier, **options).first()["items"]
    return {k: (v["t"], v["t_minus_1"]) for k, v in out.items() if v["t"] is not None}


REPORT = ("Laporan Keuangan PT Contoh Tbk\nUntuk tahun yang berakhir 31 Desember 2023\n(Dinyatakan dalam jutaan Rupiah)\n\n"
          "Pendapatan Bersih 1.250,50 1.100\nLaba Kotor 500 450")


@pytest.mark.parametrize("dialect", ["module", "service"])
def test_report_text(spark, dialect):
    assert extract(spark, REPORT, dialect=dialect, scaled=True) == {"Pendapatan bersih": (1250.5e6, 1100e6), "Laba bruto": (500e6, 450e6)}


def test_substring_longest_and_guard(spark):
    text = "jumlah aset lancar 10 9 jumlah aset 30 29"
    assert extract(spark, text)["Jumlah aset"] == (10.0, 9.0)
    assert extract(spark, text, match="longest")["Jumlah aset"] == (30.0, 29.0)
    assert extract(spark, "laba bruto laba ditahan 7") == {"Laba ditahan": (7.0, None)}
    assert extract(spark, "") == {} and extract(spark, None) == {}


def test_windows_of_the_dialects(spark):
    words = " ".join(["kata"] * 26)
    assert extract(spark, f"laba bruto {words} 7") == {}
    assert extract(spark, f"laba bruto {words} 7", dialect="service") == {"Laba bruto": (7.0, None)}
    assert extract(spark, f"laba bruto {'k' * 300} 7", dialect="service") == {}
    assert extract(spark, f"laba bruto {words} 7 laba bruto 8 1.2.3,4,5 9") == {"Laba bruto": (8.0, 9.0)}


def test_two_values(spark):
    def two(text):
        out = spark.createDataFrame([(text,)], "text string").select(X.two_values(F.col("text")).alias("m")).first()["m"]
        return {k: (v["val1"], v["val2"]) for k, v in out.items()}
    assert two("piutang usaha 5") == {"Piutang usaha": (5.0, 5.0)}
    assert two("laba sebelum pajak 5") == {"Laba/rugi sebelum pajak penghasilan": (5.0, None)}
    assert two("jumlah aset lancar 10 x 9 8") == {"Jumlah aset lancar": (10.0, 9.0)}
    assert two("laba bruto-3 4") == {"Laba bruto": (-3.0, 4.0)} and two("kosong 5") == {}


def test_split_phrase(spark):
    keywords = custom_set([(V.INVESTING_CASH, [V.INVESTING_CASH])], split_rules=[investing_split_rule("module")])
    head = "Arus kas bersih yang diperoleh dari "
    assert extract(spark, head + "1.000 (85) aktivitas investasi", keywords=keywords) == {V.INVESTING_CASH: (1000.0, 85.0)}
    assert extract(spark, head + "aktivitas operasi 5 aktivitas investasi", keywords=keywords) == {}
    assert extract(spark, head + "aktivitas investasi 9", keywords=keywords) == {}


def test_keyword_sets(spark):
    assert len(CORPORATE.items) == 24 and len(INDIVIDUAL.items) == 10 and len(with_operating_cash().items) == 25
    assert choose_set("individu") is INDIVIDUAL and choose_set(None) is CORPORATE
    assert choose_set("individu", CORPORATE) is CORPORATE
    assert dict(CORPORATE.items)["Jumlah liabilitas"][-2:] == ("Liabilitas", "LIABILITAS")


def test_document_envelope(spark):
    rows = spark.createDataFrame([("/a/lap.txt", REPORT, "korporat", "txt"), ("/a/x.txt", "Error TXT: hilang", "korporat", "txt"),
                                  ("/a/y.txt", " \n", "individu", "txt"), ("/a/z.txt", "Gaji bersih 5", "individu", "txt")],
                                 "path string, text string, applicant_type string, file_type string")
    out = {r.nama_file: r for r in X.parse_documents(rows).collect()}
    assert out["lap.txt"].tahun_pelaporan_terdeteksi == "2023" and out["lap.txt"].pengali_global_terdeteksi == 1e6
    assert out["x.txt"].error_parsing == "Error TXT: hilang" and out["x.txt"].hasil_ekstraksi_kata_kunci is None
    assert out["y.txt"].info_parsing.endswith("kosong.")
    assert out["z.txt"].hasil_ekstraksi_kata_kunci["Penghasilan Gaji"]["t"] == 5.0
    structured = {r.nama_file: r for r in X.parse_documents(rows, output_format="structured_json").collect()}
    assert structured["x.txt"].error == "Error TXT: hilang" and structured["lap.txt"].error is None


def test_pages_and_lines(spark):
    pages = spark.createDataFrame([("d", 2, "PARENT ENTITY b"), ("d", 1, " Entitas Induk a"), ("d", 3, "x" * 200 + "entitas induk"),
                                   ("d", 4, "lain"), ("e", 1, "lain")], "doc_id string, page_no int, text string")
    assert {r.doc_id: r.text for r in L.document_text(pages).collect()} == {"d": "Entitas Induk a\n\nPARENT ENTITY b", "e": ""}
    assert L.parent_pages(pages).count() == 2
    blocks = spark.createDataFrame([("d", 0, 0, 100, "a"), ("d", 1, 5, 108, "b"), ("d", 2, 0, 117, "c"), ("d", 3, 0, 130, "e"),
                                    ("d", 4, 1, 100, "x"), ("d", 5, 0, 119, " ")], "doc_id string, seq int, x_min int, y_min int, text string")
    assert [r.line_text for r in L.lines_from_blocks(blocks).orderBy("line_no").collect()] == ["a x b c", "e"]
    words = spark.createDataFrame([("d", 1, 1, 1, 1, 2, 5, "dua "), ("d", 1, 1, 1, 1, 1, 5, "satu"), ("d", 1, 1, 1, 1, 3, 4, "x"),
                                   ("d", 1, 1, 1, 2, 4, 5, " ")], "doc_id string, page int, block int, par int, line int, word_ord int, level int, text string")
    assert [r.line_text for r in L.lines_from_words(words).collect()] == ["satu dua"]


def test_spatial(spark):
    def boxes(rows):
        return spark.createDataFrame(rows, "doc_id string, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    base = [("d", 0, "Jumlah", 0., 0., 24., 10.), ("d", 1, "aset:", 26., 0., 50., 10.), ("d", 2, "9", 90., 0., 99., 10.),
            ("d", 3, "7", 60., 0., 70., 10.), ("d", 4, "8", 55., 20., 70., 30.), ("d", 5, "abc5", 52., 0., 58., 10.)]
    assert [(r.item, r.value) for r in spatial_extract(boxes(base)).collect()] == [("Jumlah aset", 7.0)]
    for unit in (0.001, 1000.0):        # pages measured in 0..1 and in tiny units: same result, few cells
        scaled = [(*b[:3], *[x * unit for x in b[3:]]) for b in base]
        assert [(r.item, r.value) for r in spatial_extract(boxes(scaled)).collect()] == [("Jumlah aset", 7.0)]
    mixed = base + [("d", 6, "ekuitas", 0., 5000., 400., 5100.), ("d", 7, "11", 900., 5000., 950., 5100.)]      # two grids in one document
    assert {(r.item, r.value) for r in spatial_extract(boxes(mixed)).collect()} == {("Jumlah aset", 7.0), ("Jumlah ekuitas", 11.0)}
    far = [("d", 0, "ekuitas", 0., 0., 10., 10.), ("d", 1, "7", 60., 0., 70., 10.)]           # 50 is not below 5 x 10
    assert spatial_extract(boxes(far)).count() == 0
    tie = base[:2] + [("d", 2, "3", 60., 0., 70., 10.), ("d", 3, "4", 60., 1., 70., 9.)]
    assert spatial_extract(boxes(tie)).first()["value"] == 3.0
    cut = [("d", SEQ_CHUNK - 1, "jumlah", 0., 0., 24., 10.), ("d", SEQ_CHUNK, "aset", 26., 0., 50., 10.),
           ("d", SEQ_CHUNK + 1, "6", 60., 0., 70., 10.), ("d", 3, "jumlah", 0., 50., 24., 60.), ("d", 5, "aset", 26., 50., 50., 60.)]
    assert spatial_extract(boxes(cut)).first()["value"] == 6.0


def test_sentiment_issues_summary(spark):
    assert apply(spark, N.sentiment, ["SENTIMEN: Positif", "laba naik, bukan rugi besar", "kerugian", "sentimen: ?\nSentimen: netral turun",
                                      "SENTIMEN: negatif positif"]) == ["Positif", "Netral", "Negatif", "Netral", "Negatif"]
    numbered = "ISU UTAMA:\n1. satu\n2. dua\n3. tiga\n4. empat"
    assert apply(spark, N.key_issues, [numbered, "tanpa", "ISU UTAMA: Denda\n• Izin\nSENTIMEN: x\n1. lewat", "Ada kendala pasokan"]) == [
        ["satu", "dua", "tiga"], [V.ISSUE_DEFAULT], ["Denda", "Izin"], ["Ada kendala pasokan"]]
    long = "Kalimat pertama yang cukup panjang. Pendek. Kalimat kedua yang cukup panjang! Kalimat ketiga yang cukup panjang? Dan ini keempat juga panjang"
    assert apply(spark, N.summary, ["RINGKASAN: isi **[1]** x", "RINGKASAN:\na\nb\nSENTIMEN: y", long, "pendek",
                                    "Tentu, saya akan menganalisis: " + "Kalimat pertama yang cukup panjang."]) == [
        "isi  x", "a b", "Kalimat pertama yang cukup panjang. Kalimat kedua yang cukup panjang. Kalimat ketiga yang cukup panjang.",
        V.SUMMARY_DEFAULT, "Kalimat pertama yang cukup panjang."]


def test_citations_and_sources(spark):
    rows = spark.sql("""SELECT 'abcdefg' AS t, array(named_struct('end_index', 3, 'chunk_indices', array(0, 9)),
        named_struct('end_index', 5, 'chunk_indices', array(1))) AS s, array(named_struct('title', 'A', 'uri', 'u'),
        named_struct('title', CAST(NULL AS STRING), 'uri', CAST(NULL AS STRING))) AS c""")
    out = rows.select(replies.add_citations(F.col("t"), F.col("s"), F.size("c")).alias("x"), replies.source_list(F.col("c")).alias("y")).first()
    assert out["x"] == "abc **[1]**de **[2]**fg"
    assert [tuple(s) for s in out["y"]] == [("[1]", "A", "u"), ("[2]", "Source 2", "N/A")]


def test_replies(spark):
    good = 'x ```json\n{"Laba bruto": {"current_year": 5, "previous_year": null,},} // c\n```'
    out = apply(spark, replies.parse_statement_reply, [good, "bukan json"])
    assert out[0]["items"]["Laba bruto"]["t"] == 5.0 and out[0]["error"] is None
    assert out[1]["error"] == replies.PARSE_ERROR and out[1]["raw"] == "bukan json"
    news = apply(spark, replies.parse_news_reply, ['```json\n{"summary": "a", "sentiment": "Positive"}\n```'])[0]
    assert news["summary"] == "a" and news["key_issues"] == [] and news["sources"] == []


def test_outlook(spark):
    outlook = spark.createDataFrame([("Keuangan", "Perbankan", "Rendah")], "industry_main string, industry_sub string, outlook string")
    rows = spark.createDataFrame([("Keuangan", "Perbankan"), ("Keuangan", "Lain"), ("Keuangan", ""), (None, "Perbankan")],
                                 "industry_main string, industry_sub string")
    assert sorted(r.outlook for r in sector_outlook(rows, outlook).collect()) == sorted([
        "Rendah", "Tidak Diketahui", "Sub-industri tidak disediakan untuk industri utama: Keuangan.", "Informasi industri tidak disediakan."])
    assert sector_outlook(rows, None).first()["outlook"].startswith("Data risiko") and \
        sector_outlook(rows, outlook, "x").first()["outlook"] == "Gagal memuat data risiko: x"


def test_names(spark):
    assert apply(spark, T.file_stem, ["a.b.pdf", "plain", ".env"]) == ["a.b", "plain", ".env"]
    assert apply(spark, T.file_extension, ["a.B.PDF", "plain"]) == ["pdf", ""]
    assert apply(spark, T.applicant_slug, [" PT. Contoh (Tbk) "]) == ["PT_Contoh_Tbk"]
    assert apply(spark, lambda c: T.words(c, ["dan"]), ["Laba dan_ rugi, DAN 12x"]) == [["laba", "rugi", "12x"]]


def test_records_from_replies(spark):
    outlook = spark.createDataFrame([("Keuangan", "Bank", "Rendah")], "industry_main string, industry_sub string, outlook string")
    rows = spark.createDataFrame([("A", "Keuangan", "Bank", '{"summary": "s", "sentiment": "Mixed", "key_issues": ["i"], "sources": []}'),
                                  ("B", None, None, "rusak")], "applicant string, industry_main string, industry_sub string, reply string")
    out = {r.applicantName: r for r in N.risk_records_from_replies(rows, outlook).collect()}
    assert out["A"].overallSentiment == "Mixed" and out["A"].keyIssues == ["i"] and out["A"].industrySectorOutlook == "Rendah"
    assert out["B"].overallSentiment == "Error" and out["B"].keyIssues == [] and out["B"].supportingSources == []


def test_replies_keep_addresses_inside_strings(spark):
    news = '{"summary": "a // b",\n"sources": [{"title": "t", "url": "https://x.id/1"}],\n"sentiment": "Positive"}'
    out = apply(spark, replies.parse_news_reply, [news, "{}", "no json", '{"summary": "a",}'])
    assert out[0]["summary"] == "a // b" and out[0]["sources"][0]["url"] == "https://x.id/1"
    assert out[1]["summary"] is None and out[1]["key_issues"] == [] and out[2] is None
    noted = 'Hasil: {"a//b": {"current_year": 1, /* c */ "previous_year": 2,}, // d\n}'
    items = apply(spark, replies.parse_statement_reply, [noted])[0]["items"]
    assert items["a//b"]["t"] == 1 and items["a//b"]["t_minus_1"] == 2


def test_repeated_outlook_entries_do_not_double_applicants(spark):
    rows = spark.createDataFrame([(1, "A", "B"), (2, "A", "C")], "id int, industry_main string, industry_sub string")
    outlook = spark.createDataFrame([("A", "B", "Tinggi", 1), ("A", "B", "Rendah", 2)],
                                    "industry_main string, industry_sub string, outlook string, pos int")
    out = {r.id: r.outlook for r in sector_outlook(rows, outlook).collect()}
    assert len(out) == 2 and out[1] == "Rendah"
    assert {r.id: r.outlook for r in sector_outlook(rows, outlook.drop("pos")).collect()}[1] == "Tinggi"
    assert sector_outlook(rows, outlook).count() == 2


def test_spatial_joins_never_broadcast(spark):
    """However small Spark takes the boxes to be: boxes made by a generator are many more than it counts."""
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.inline(F.array(*[F.struct(
        F.lit(i).alias("seq"), F.lit(w).alias("text"), F.lit(50.0 * i).alias("x0"), F.lit(0.0).alias("y0"),
        F.lit(50.0 * i + 40).alias("x1"), F.lit(10.0).alias("y1")) for i, w in enumerate(["Jumlah", "aset", "7"])])))
    found = spatial_extract(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.doc_id, r.item, r.value) for r in found.collect()) == [(i, "Jumlah aset", 7.0) for i in range(3)]


def test_word_lines_shuffle_texts_not_words(spark, tmp_path):
    from ledgermill.plans.queries_documents import word_lines
    rows = [(1, " ".join(f"k{i}" for i in range(20))), (1, "lain dua"), (None, "a b  c"), (None, "a x"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = word_lines(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" in plan
    lines = sorted((r.doc_id or 0, r.line, sorted(r.line_text.split())) for r in found.collect())
    assert lines == [(0, 0, ["b", "c", "x"]), (1, 0, sorted([f"k{i}" for i in range(1, 8)] + ["dua"])),
                     (1, 1, sorted(f"k{i}" for i in range(8, 16) if i != 13)), (1, 2, ["k16", "k17", "k18", "k19"])]
