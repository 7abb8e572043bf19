"""Registered queries over documents, boxes, analyst texts, evaluation and incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions import replies, text as T
from ledgermill.functions.amounts import maybe_numeric, parse_amount
from ledgermill.functions.headers import report_year, unit_multiplier
from ledgermill.operators import dictionary, evaluation as E, extraction as X, incremental as I, layout as L, narrative as N, roc as R
from ledgermill.operators.spatial import spatial_extract
from ledgermill.plans import derived as D
from ledgermill.sources.keywords import CORPORATE, custom_set, investing_split_rule, keyword_table
from ledgermill.sources.readers import delimited_text
from ledgermill.sources.writers import period_records


def amount_module(spark: SparkSession, sf: str) -> DataFrame:
    return D.amount_strings(spark, sf).select("o_orderkey", parse_amount(F.col("amount_text")).alias("amount"))


def amount_service(spark: SparkSession, sf: str) -> DataFrame:
    return D.amount_strings(spark, sf).select("o_orderkey", parse_amount(F.col("amount_text"), "service").alias("amount"))


def numeric_guard(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), maybe_numeric)
    return D.table(spark, sf, "documents").select("doc_id", F.size(tokens).cast("bigint").alias("numeric_tokens"))


def unit_multipliers(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(D.cycle(F.col("doc_id"), D.UNIT_HEADERS), F.col("text"))
    return D.table(spark, sf, "documents").select("doc_id", unit_multiplier(text).alias("multiplier"))


def report_years(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(D.cycle(d, D.YEAR_HEADERS), (F.pmod(d * 7, F.lit(160)) + 1950).cast("string"), F.lit(", halaman 12.2031\n"),
                    F.col("text"))
    return D.spread(D.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", report_year(text).alias("report_year"))


def _annual(spark: SparkSession, sf: str, **options) -> DataFrame:
    docs = D.filed_documents(spark, sf).withColumn("multiplier", unit_multiplier(F.col("text")))
    found = X.annual_extract(docs, multiplier=F.col("multiplier"), **options).drop("multiplier")
    return X.split_periods(X.items_long(found))


def annual_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _annual(spark, sf)


def annual_extract_longest(spark: SparkSession, sf: str) -> DataFrame:
    return _annual(spark, sf, dialect="service", match="longest")


def dictionary_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The corporate phrases as a table, found by the index; the same rows as `annual_extract`."""
    docs = D.filed_documents(spark, sf).withColumn("multiplier", unit_multiplier(F.col("text")))
    found = dictionary.dictionary_extract(docs, keyword_table(spark, CORPORATE), multiplier=F.col("multiplier"))
    return X.split_periods(found.drop("multiplier"))


def dictionary_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of one to five words cut from the benchmark texts, as a custom table, searched in all documents."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1)), F.lit(5))
    cut = D.table(spark, sf, "benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.posexplode(starts).alias("n", "at"))
    phrases = cut.select(F.concat(F.lit("butir "), F.col("item_id").cast("string")).alias("item"), F.col("item_id").cast("int").alias("item_ord"),
                         F.array_join(F.slice("w", F.col("at"), F.pmod(F.col("n"), F.lit(5)) + 1), " ").alias("variation"), F.col("n").alias("var_ord"))
    return dictionary.dictionary_matches(D.spread(D.table(spark, sf, "documents").select("doc_id", "text")), phrases)


def two_value_extract(spark: SparkSession, sf: str) -> DataFrame:
    return X.two_values_long(X.two_value_extract(D.filed_documents(spark, sf)))


def split_phrase_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers between the two halves of the investing cash flow phrase; operating and far-off halves do not count."""
    o, c = F.col("o_orderkey"), F.lit("Arus kas bersih yang diperoleh dari ")
    middle = F.concat(F.format_number(o + 1000, 0), F.lit(" ("), F.col("o_custkey").cast("string"), F.lit(") "))
    shapes = F.array(
        F.concat(c, middle, F.lit("aktivitas investasi")),
        F.concat(c, F.lit("aktivitas operasi 5 6 aktivitas investasi "), c, middle, F.lit("aktivitas investasi")),
        F.concat(c, middle, F.repeat(F.lit("panjang "), 30), F.lit("aktivitas investasi")),
        F.concat(c, F.lit("aktivitas investasi "), middle))
    keywords = custom_set([(V.INVESTING_CASH, [V.INVESTING_CASH])], split_rules=[investing_split_rule("module")])
    docs = D.table(spark, sf, "orders").select("o_orderkey", F.get(shapes, F.pmod(o, F.lit(4)).cast("int")).alias("text"))
    return X.items_long(X.annual_extract(docs, keywords)).select("o_orderkey", "t", "t_minus_1")


def spatial_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return spatial_extract(D.order_boxes(spark, sf))


def block_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.lines_from_blocks(D.event_blocks(spark, sf)).select("doc_id", "line_no", "line_text")


def word_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.lines_from_words(D.document_words(spark, sf))


def parent_documents(spark: SparkSession, sf: str) -> DataFrame:
    return L.document_text(D.conversation_pages(spark, sf))


def document_envelope(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    k = F.pmod(d, F.lit(9))
    docs = D.filed_documents(spark, sf).select(
        F.concat(F.lit("/in/lap."), d.cast("string"), F.lit(".txt")).alias("path"),
        F.when(k == 4, "Error TXT: rusak").when(k == 5, " \n ").otherwise(F.col("text")).alias("text"),
        F.when(k == 6, "individu").otherwise("korporat").alias("applicant_type"), F.lit("txt").alias("file_type"))
    items = F.col("hasil_ekstraksi_kata_kunci")
    found = F.size(F.filter(F.map_values(items), lambda v: v["t"].isNotNull()))
    return X.parse_documents(docs).select(
        "nama_file", "info_parsing", "error_parsing", F.length("teks_ekstrak_mentah").cast("bigint").alias("text_chars"),
        F.col("pengali_global_terdeteksi").alias("multiplier"),
        F.when(items.isNotNull(), F.size(items).cast("bigint")).alias("items"),
        F.when(items.isNotNull(), found.cast("bigint")).alias("found"))


def document_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with their values: from a structured reply where there is one, else from the text; failed documents have an error."""
    d = F.col("doc_id")
    pair = F.struct((d * 3).cast("double").alias("t"), F.lit(None).cast("double").alias("t_minus_1"))
    docs = D.filed_documents(spark, sf).select(
        F.concat(F.lit("/in/lap."), d.cast("string"), F.lit(".txt")).alias("path"),
        F.when(F.pmod(d, F.lit(9)) == 4, "Error TXT: rusak").when(F.pmod(d, F.lit(9)) == 5, " \n ").otherwise(F.col("text")).alias("text"),
        F.lit("korporat").alias("applicant_type"), F.lit("txt").alias("file_type"),
        F.when(F.pmod(d, F.lit(4)) == 1, F.create_map(F.lit(V.EQUITY), pair)).alias("structured"))
    parsed = X.parse_documents(docs, output_format="structured_json").select(
        "nama_file", "error_parsing", "error", F.col("pengali_global_terdeteksi").alias("multiplier"),
        F.explode_outer(F.map_filter("hasil_ekstraksi_terstruktur", lambda k, v: v["t"].isNotNull())).alias("item", "pair"))
    return parsed.select("nama_file", "error_parsing", "error", "multiplier", "item", "pair.t", "pair.t_minus_1")


def document_views(spark: SparkSession, sf: str) -> DataFrame:
    """The text view and the items view of parsed documents side by side."""
    docs = D.filed_documents(spark, sf).select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), "text", F.lit("korporat").alias("applicant_type"), F.lit("txt").alias("file_type"))
    parsed = X.parse_documents(docs)
    texts = X.text_view(parsed).select("nama_file", F.md5(F.col("teks_ekstrak_mentah").cast("binary")).alias("text_md5"), "info_parsing")
    items = X.items_view(parsed).select("nama_file", F.col("pengali_global_terdeteksi").alias("multiplier"),
                                        F.try_element_at("hasil_ekstraksi_kata_kunci", F.lit(V.SALES))["t"].alias("sales"))
    return texts.join(items, "nama_file")


def reply_risk_records(spark: SparkSession, sf: str) -> DataFrame:
    """Risk records from news replies in four shapes: fenced, bare, without lists, unreadable; and the two views of them."""
    k = F.col("conv_id") * 8 + F.col("turn")
    source = F.struct(F.concat(F.lit("T"), k.cast("string")).alias("title"), F.lit("http://a//b").alias("url"))
    full = F.to_json(F.struct(F.concat(F.lit("Ringkas "), k.cast("string")).alias("summary"), F.lit("Positif").alias("sentiment"),
                              F.array(F.lit("utang"), F.lit("kurs, // harga")).alias("key_issues"), F.array(source).alias("sources")))
    bare = F.to_json(F.struct(F.lit("tanpa daftar").alias("summary"), F.lit("Netral").alias("sentiment")))
    shapes = F.array(F.concat(F.lit("Berikut:\n```json\n"), full, F.lit("\n```")), full, bare, F.lit("maaf, tidak ada"))
    outlook = D.table(spark, sf, "region").select(F.col("r_name").alias("industry_main"), F.lit("Umum").alias("industry_sub"), F.lit("Tinggi").alias("outlook"))
    answers = D.table(spark, sf, "conversations").select(
        F.concat(F.lit("PT "), k.cast("string")).alias("applicant"), D.cycle(k, ["ASIA", "LAIN", "ASIA", ""]).alias("industry_main"),
        F.lit("Umum").alias("industry_sub"), F.get(shapes, F.pmod(k, F.lit(4)).cast("int")).alias("reply"))
    records = N.risk_records_from_replies(answers, outlook, F.lit("2024-01-31 06:00:00").cast("timestamp"))
    news = N.news_view(records).select("applicantName", "groundedSummary", "overallSentiment", F.array_join("keyIssues", "|").alias("issues"),
                                       F.array_join(F.transform("supportingSources", lambda s: F.concat_ws(" ", s["title"], s["url"])), "|").alias("sources"))
    return news.join(N.outlook_view(records).select("applicantName", "industrySectorOutlook"), "applicantName")


def period_files(spark: SparkSession, sf: str) -> DataFrame:
    """Shape of the two written result sets."""
    docs = X.annual_extract(D.filed_documents(spark, sf)).withColumn("nama_file", F.col("doc_id").cast("string"))
    return period_records(docs.drop("doc_id")).select(
        "nama_file", "period_kind", F.size("hasil_ekstraksi").cast("bigint").alias("items"))


def delimited_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Three rows per file; the first holds a quoted line break and a comma, the last is too long in every tenth file and has an
    open quote in another tenth."""
    k = F.col("o_orderkey")
    content = F.concat(k.cast("string"), F.lit(',"'), F.col("o_orderstatus"), F.lit("\r\n"), F.col("o_orderpriority"),
                       F.lit(',\n",,\"a,\"\"b\"\"\"\n\n'), F.col("o_custkey").cast("string"), F.lit(",x\r\n"),
                       F.when(F.pmod(k, F.lit(10)) == 0, "1,2,3,4,5").when(F.pmod(k, F.lit(10)) == 1, '1,2,"3\n4,5').otherwise('1,2"x,3,4'))
    return D.table(spark, sf, "orders").select("o_orderkey", delimited_text(content).alias("text"))


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    name = T.base_name(F.concat(F.lit("/arsip/"), F.col("url"), F.lit(".PDF")))
    return D.table(spark, sf, "pages").select(
        "page_id", T.file_stem(name).alias("stem"), T.file_extension(name).alias("extension"),
        T.applicant_slug(F.col("url")).alias("slug"))


def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.words(F.col("text"), ["the", "and", "de", "la"])
    return D.table(spark, sf, "documents").select("doc_id", F.size(tokens).cast("bigint").alias("tokens"),
                                                  F.size(F.array_distinct(tokens)).cast("bigint").alias("distinct_tokens"))


def display_times(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "events").select("event_id", T.display_time(F.col("ts").cast("timestamp")).alias("shown"))


def reply_items(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in four shapes to items for t and t-1."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"Laba bruto": {"current_year": '), k.cast("string"), F.lit(', "previous_year": null,},}'))
    shapes = F.array(
        F.concat(F.lit("Berikut:\n```json\n"), body, F.lit("\n```\nselesai")), F.concat(F.lit("hasil "), body),
        F.concat(F.lit("/* catatan */"), body, F.lit("// akhir\n")), F.lit("tidak ada data"))
    parsed = D.table(spark, sf, "orders").select("o_orderkey", replies.parse_statement_reply(
        F.get(shapes, F.pmod(k, F.lit(4)).cast("int"))).alias("r"))
    item = F.try_element_at(F.col("r.items"), F.lit("Laba bruto"))
    return parsed.select("o_orderkey", item["t"].alias("t"), item["t_minus_1"].alias("t_minus_1"), "r.error",
                         F.col("r.raw").isNotNull().alias("kept_raw"))


def sentiments(spark: SparkSession, sf: str) -> DataFrame:
    counts = N.keyword_counts(F.col("text"))
    return D.analyst_texts(spark, sf).select("applicant_id", N.sentiment(F.col("text")).alias("sentiment"),
                                             counts["positive"].alias("positive"), counts["negative"].alias("negative"))


def issues(spark: SparkSession, sf: str) -> DataFrame:
    return D.analyst_texts(spark, sf).select("applicant_id", F.array_join(N.key_issues(F.col("text")), " | ").alias("issues"))


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return D.analyst_texts(spark, sf).select("applicant_id", N.summary(F.col("text")).alias("summary"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    return D.analyst_texts(spark, sf).select("applicant_id", replies.add_citations(
        F.col("text"), F.col("supports"), F.coalesce(F.size("chunks"), F.lit(0))).alias("cited"))


def risk_records(spark: SparkSession, sf: str) -> DataFrame:
    outlook = spark.createDataFrame([], "industry_main STRING, industry_sub STRING, outlook STRING")
    records = N.risk_records(D.analyst_texts(spark, sf), outlook)
    return records.select("applicantName", "overallSentiment", "industrySectorOutlook",
                          F.size("supportingSources").cast("bigint").alias("sources"),
                          F.get("supportingSources", F.lit(1))["title"].alias("second_title"))


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = E.compare_with_truth(D.order_extractions(spark, sf), D.order_truth(spark, sf))
    rounded = ["precision", "recall", "f1_score", "detection_rate", "exact_match_rate", "mean_absolute_error",
               "mean_percentage_error"]
    return m.select("item", "tp", "fp", "fn", "gt_occurrences", "exact_value_matches", "numeric_pairs",
                    *[F.round(c, 4).alias(c) for c in rounded])


def eval_overall(spark: SparkSession, sf: str) -> DataFrame:
    return E.overall_accuracy(E.compare_with_truth(D.order_extractions(spark, sf), D.order_truth(spark, sf)))


def eval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return E.coverage(D.order_extractions(spark, sf))


def detection_auc(spark: SparkSession, sf: str) -> DataFrame:
    return E.detection_auc(D.order_extractions(spark, sf), D.order_truth(spark, sf))


def _quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "labels").join(D.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(
        (F.pmod("n_chars", F.lit(997)) / 1000.0).alias("score"), F.col("quality").alias("hit"))


def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return R.roc_points(_quality_scores(spark, sf)).select("score", "fpr", "tpr")


def roc_area(spark: SparkSession, sf: str) -> DataFrame:
    return R.auc(_quality_scores(spark, sf))


def multiclass_areas(spark: SparkSession, sf: str) -> DataFrame:
    out = R.multiclass_auc(D.event_predictions(spark, sf), D.EVENT_CLASSES)
    return out.select("measure", "class", F.round("auc", 9).alias("auc"))


def _page_files(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages").select(F.col("url").alias("path"), "page_id", F.length("html").cast("string")
                                              .alias("modificationTime"))


def new_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are new or changed since the stored run, which saw other sizes of the German and French pages."""
    files = I.with_input_key(_page_files(spark, sf), "method:page")
    seen = _page_files(spark, sf).withColumn("modificationTime", F.when(
        F.rlike("path", F.lit("/(?:de|fr)/")), F.lit("0")).otherwise(F.col("modificationTime")))
    return I.pending(files, I.with_input_key(seen, "method:page")).select("page_id", "path", "key")


def purged_results(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-31 06:00:00").cast("timestamp")
    rows = D.table(spark, sf, "events").withColumn("stored_at", F.col("ts").cast("timestamp"))
    kept = I.purge(rows, "stored_at", now, 25 * 24 * 60 * 60)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("first_event"))


QUERIES = {f.__name__: f for f in (
    amount_module, amount_service, numeric_guard, unit_multipliers, report_years, annual_extract, annual_extract_longest,
    dictionary_extract, dictionary_matches, two_value_extract, split_phrase_extract, spatial_amounts, block_lines, word_lines, parent_documents,
    document_envelope, document_items, document_views, reply_risk_records, period_files, delimited_rows, file_names, word_tokens, display_times, reply_items, sentiments,
    issues, summaries, citations, risk_records, eval_metrics, eval_overall, eval_coverage, detection_auc, roc_curve,
    roc_area, multiclass_areas, new_files, purged_results)}
