"""Tables that Spark derives from the given ones: statements, documents, boxes and blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import fixed_values as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_BYTES_PER_CORE = 32 * 1024 * 1024


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small input over all cores. A file of one row group is one task however many cores there are; an input
    with enough bytes for every core has enough splits and is left as it is, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPREAD_BYTES_PER_CORE else rows


PART_BYTES = 4 * 1024 * 1024


def spread_by(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one key in one task, over all cores and with some megabytes a task: what is grouped by the key and more needs no other
    shuffle. For rows that grow when they are taken apart."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), key)


def whole(value: Column) -> Column:
    """A double rounded half away from zero, as `round` does, without a decimal number for every row."""
    near = F.rint(value)
    return F.when(F.abs(value - near) == 0.5, value + F.signum(value) * 0.5).otherwise(near).cast("bigint")


def _cents(name: str) -> Column:
    return whole(F.col(name) * 100)


def supplier_month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number sums per supplier and month: order-independent, and combined map-side before the one shuffle."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("company"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias("period"),
        _cents("l_extendedprice").alias("cents"), _cents("l_discount").alias("disc"), _cents("l_tax").alias("tax"),
        whole(F.col("l_quantity").cast("double")).alias("qty"), c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"))

    def total(value: Column, cond: Column | None = None) -> Column:
        return F.sum(value if cond is None else F.when(cond, value).otherwise(0))
    return rows.groupBy("company", "period").agg(
        total(c("cents")).alias("gross"), total(c("cents"), c("flag") == "R").alias("ret"),
        total(c("cents"), c("flag") == "A").alias("acc"), total(c("cents"), c("status") == "O").alias("open"),
        total(c("cents") * (100 - c("disc"))).alias("sales"), total(c("cents") * c("tax")).alias("tax"),
        total(c("cents") * c("disc")).alias("disc"), total(c("qty")).alias("qty"))


def item_values(c: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Statement items as doubles from the whole-number sums, which `c` names."""

    def money(units: Column, scale: float) -> Column:
        return units.cast("double") / scale
    return {
        V.SALES: money(c("sales"), 10000.0),
        V.CURRENT_ASSETS: money(c("open"), 100.0),
        V.CURRENT_LIABILITIES: money(c("ret"), 100.0),
        V.ASSETS: money(c("gross") + c("acc"), 100.0),
        V.LIABILITIES: money(c("ret") + c("acc"), 100.0),
        V.EQUITY: money(c("gross") - c("ret"), 100.0),
        V.RETAINED: money(c("sales") - c("ret") * 100, 10000.0),
        V.INTEREST: money(c("tax"), 10000.0),
        V.PRETAX: money(c("disc") * 4 - c("tax"), 10000.0),
        V.RECEIVABLES: money(c("acc"), 100.0),
        V.GROSS_PROFIT: money(c("sales") - c("qty") * 10000000, 10000.0),
        V.NET_INCOME: money(c("disc"), 10000.0),
        V.SELLING: money(c("tax"), 10000.0),
        V.ADMIN: c("qty").cast("double"),
        V.DEPRECIATION: c("qty").cast("double"),
        V.PPE_GROSS: money(c("gross"), 100.0),
        V.PPE_NET: money(c("gross") - c("ret"), 100.0),
        V.NON_CURRENT_ASSETS: money(c("gross") + c("acc") - c("open"), 100.0),
        V.OPERATING_CASH: money(c("open"), 1000.0),
    }


def _items(of: Callable[[str], Column] = F.col) -> Column:
    return F.create_map(*[x for name, value in item_values(of).items() for x in (F.lit(name), value)])


def supplier_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, period, items MAP<STRING, DOUBLE>."""
    return supplier_month_totals(spark, sf_dir).select("company", "period", _items().alias("items"))


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`period_pairs` of the statements: company, period, items, items_t1. The sums are paired and shuffled, not the items made of them,
    which are several times as many bytes. A company has one statement a period, so the earlier one is the same."""
    from ledgermill.operators.statements import period_pairs
    totals = supplier_month_totals(spark, sf_dir)
    sums = [c for c in totals.columns if c not in ("company", "period")]
    pairs = period_pairs(totals.select("company", "period", F.struct(*sums).alias("sums")), ("sums",))
    return pairs.select("company", "period", _items(lambda c: F.col(f"sums.{c}")).alias("items"),
                        F.when(F.col("sums_t1").isNotNull(), _items(lambda c: F.col(f"sums_t1.{c}"))).alias("items_t1"))


def cycle(key: Column, texts: list[str]) -> Column:
    """One of the texts by key modulo their number."""
    return F.get(F.array(*[F.lit(t) for t in texts]), F.pmod(key, F.lit(len(texts))).cast("int"))


def amount_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written in seven layouts by o_orderkey modulo 7."""
    cents = _cents("o_totalprice")
    whole, part = F.floor(cents / 100).cast("bigint"), F.pmod(cents, F.lit(100))
    comma = F.format_number(F.col("whole"), 0)
    dots = F.replace(comma, F.lit(","), F.lit("."))
    two, four = F.lpad(F.col("part").cast("string"), 2, "0"), F.lpad(F.col("part").cast("string"), 4, "0")
    text = F.col("whole").cast("string")
    layouts = [
        F.concat(F.lit("Rp"), dots, F.lit(","), two), F.concat(comma, F.lit("."), two),
        F.concat(F.lit("("), dots, F.lit(")")), F.concat(text, F.lit(","), F.floor(F.col("part") / 10).cast("string")),
        F.concat(text, F.lit("."), two), F.concat(F.lit("-"), text, F.lit(","), four),
        F.concat(F.lit("Catatan "), text, F.lit(" juta")),
    ]
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).select("o_orderkey", whole.alias("whole"), part.cast("bigint").alias("part"))
    return rows.select("o_orderkey", F.get(F.array(*layouts), F.pmod("o_orderkey", F.lit(7)).cast("int")).alias("amount_text"))


UNIT_HEADERS = ["(Dinyatakan dalam jutaan Rupiah) ", "Disajikan dalam ribuan mata uang Rupiah ", "Dalam miliar Rp ",
                "(dinyatakan dalam triliun Rupiah) ", ""]
YEAR_HEADERS = ["Laporan keuangan tahunan untuk tahun yang berakhir pada tanggal 31 Desember ", "Periode enam bulan yang "
                "berakhir pada 30 Juni ", "Tahun buku ", "Neraca per 31 Maret ", "Jilid "]


def filed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a unit header, statement lines made of doc_id and n_chars, then the whole document text."""
    c = F.col
    n, d = c("n_chars"), c("doc_id")
    lines = F.concat(
        F.lit("\nPendapatan Bersih "), F.format_number(n * 1000 + d + 1000, 0), F.lit(" "), F.format_number(n * 900 + d + 1000, 0),
        F.lit("\nLaba Kotor "), F.format_number(n + 1, 0), F.lit("\nBeban Usaha ("), F.format_number(n * 7 + 1000, 0),
        F.lit(") "), F.format_number(d + 2, 0), F.lit("\nJumlah Aset Lancar: "), F.format_number(n * 11 + 5, 0), F.lit(" "),
        F.format_number(n * 10 + 5, 0), F.lit("\nTotal   aset "), F.format_number(n * 20 + 7, 0), F.lit(" "),
        F.format_number(n * 19 + 7, 0), F.lit("\n"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")).select("doc_id", F.concat(cycle(d, UNIT_HEADERS), lines, c("text")).alias("text"))


def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven boxed words per order; the offsets of the numbers vary with the order key."""
    c, k = F.col, F.col("o_orderkey")
    shift, drop = F.pmod(k, F.lit(5)) * 150, F.pmod(k, F.lit(4)) * 4

    def box(seq: int, text: Column | str, x: Column | float, y: Column | float, width: float) -> Column:
        x = x if isinstance(x, Column) else F.lit(x)
        y = y if isinstance(y, Column) else F.lit(y)
        text = text if isinstance(text, Column) else F.lit(text)
        return F.struct(F.lit(seq).alias("seq"), text.alias("text"), x.cast("double").alias("x0"), y.cast("double").alias("y0"),
                        (x + width).cast("double").alias("x1"), (y + 10).cast("double").alias("y1"))
    cust = c("o_custkey").cast("string")
    boxes = F.array(
        box(0, "Jumlah", 0, 0, 40), box(1, "ASET:", 45, 0, 35), box(2, cust, 100 + shift, drop, 50),
        box(3, F.concat(F.lit("(2"), k.cast("string"), F.lit(")")), 180, 0, 50), box(4, "Laba", 0, 40, 30),
        box(5, "Ditahan", 34, 40, 30), box(6, F.concat(k.cast("string"), F.lit("9")), 70 + shift, 40 + drop, 40),
        box(7, F.concat(cust, F.lit("abc")), 66, 40, 20), box(8, "ekuitas", 0, 80, 50), box(9, F.concat(F.lit("7"), cust),
                                                                                             51, 80 + drop, 30),
        box(10, F.concat(F.lit("8"), cust), 52, 80, 30))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(
        k.alias("doc_id"), F.inline(boxes))


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), e.alias("seq"), F.pmod(e * 7919, F.lit(1000)).alias("x_min"),
        F.pmod(e * 104729, F.lit(3000)).alias("y_min"), F.col("event_type").alias("text"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pos").cast("bigint")
    # the texts are shuffled once, and not their words with five keys each
    docs = spread_by(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return words.select(
        "doc_id", F.floor(p / 400).alias("page"), F.pmod(F.floor(p / 80), F.lit(5)).alias("block"),
        F.pmod(F.floor(p / 40), F.lit(2)).alias("par"), F.pmod(F.floor(p / 8), F.lit(5)).alias("line"),
        p.alias("word_ord"), F.when(F.pmod(p, F.lit(13)) == 0, 4).otherwise(5).alias("level"), "text")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = cycle(F.col("turn"), ["Catatan Entitas Induk\n", "Laporan ", "PARENT ENTITY only\n"])
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.concat(head, "text").alias("text"))


def analyst_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analyst text per conversation turn in six shapes, with chunks and supports."""
    c = F.col
    key = c("conv_id") * 8 + c("turn")
    flat = F.regexp_replace("text", "\n", " ")
    declared = cycle(key, ["SENTIMEN: Positif", "SENTIMEN: agak negatif", "sentimen: Netral", "SENTIMEN: campuran",
                           "laba naik dan tumbuh", "kerugian"])
    issues = cycle(key, [
        "ISU UTAMA:\n1. Utang tinggi\n2. Arus kas lemah\n3. Pasar turun\n4. Sengketa", "ISU UTAMA: Likuiditas ketat\n- Denda pajak",
        "ISU UTAMA:\nTekanan harga bahan baku\npendek\nKESIMPULAN: selesai\n1. tidak ikut", "Ada risiko kurs yang besar",
        "tanpa pokok", "ISU UTAMA: 1. awal\n2. Izin tambang"])
    head = cycle(key, ["RINGKASAN: Kinerja stabil **[3]** sepanjang tahun\n", "RINGKASAN:\nBaris pertama\nBaris kedua\n",
                       "Berikut adalah analisis: ", "RINGKASAN: \n", "", "RINGKASAN:\n\n"])
    text = F.concat(head, declared, F.lit("\n"), issues, F.lit("\n"), flat)
    chunk = F.struct(F.concat(F.lit("T"), c("turn").cast("string")).alias("title"), F.lit(None).cast("string").alias("uri"))
    chunks = F.when(F.pmod(key, F.lit(4)) == 0, F.lit(None).cast("array<struct<title:string,uri:string>>")).otherwise(
        F.array(chunk, F.struct(F.lit(None).cast("string").alias("title"), F.lit("http://x").alias("uri"))))
    supports = F.when(F.pmod(key, F.lit(4)) != 0, F.array(
        F.struct(F.lit(3).alias("end_index"), F.array(F.lit(0), F.lit(5)).alias("chunk_indices")),
        F.struct(F.lit(5).alias("end_index"), F.array(F.lit(1)).alias("chunk_indices"))))
    return table(spark, sf_dir, "conversations").select(
        key.alias("applicant_id"), F.concat(F.lit("PT. Contoh "), key.cast("string")).alias("applicant"),
        F.lit(None).cast("string").alias("industry_main"), F.lit(None).cast("string").alias("industry_sub"),
        text.alias("text"), chunks.alias("chunks"), supports.alias("supports"))


def order_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction records per order: nama_file and items; some items are absent or null by order key."""
    k, c = F.col("o_orderkey"), F.col

    def pair(value: Column, gone: Column | None = None) -> Column:
        v = value.cast("double")
        return F.struct((v if gone is None else F.when(~gone, v)).alias("t"), F.lit(None).cast("double").alias("t_minus_1"))
    entries = F.array(
        F.struct(F.lit(V.SALES).alias("key"), pair(c("o_totalprice")).alias("value")),
        F.struct(F.lit(V.ASSETS).alias("key"), pair(c("o_custkey"), F.pmod(k, F.lit(3)) == 0).alias("value")),
        F.struct(F.lit(V.EQUITY).alias("key"), pair(F.pmod(k, F.lit(10))).alias("value")),
        F.struct(F.lit("info_sumber").alias("key"), pair(F.lit(1)).alias("value")))
    items = F.map_from_entries(F.filter(entries, lambda e: (e["key"] != V.EQUITY) | (F.pmod(k, F.lit(4)) != 1)))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).select(
        F.concat(F.lit("doc_"), k.cast("string"), F.lit(".pdf")).alias("nama_file"), items.alias("items"),
        F.when(F.pmod(k, F.lit(50)) == 7, F.lit("Error: rusak")).alias("error_flag"),
        F.when(F.pmod(k, F.lit(50)) == 8, F.lit("teks kosong")).otherwise(F.lit("ok")).alias("info_parsing"))


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of the orders that are not pending, partly differing from the extraction."""
    k, c = F.col("o_orderkey"), F.col
    values = F.array(
        F.struct(F.lit(V.SALES).alias("key"), F.when(F.pmod(k, F.lit(5)) == 0, F.lit(1000.0)).otherwise(c("o_totalprice")).alias("value")),
        F.struct(F.lit(V.ASSETS).alias("key"), c("o_custkey").cast("double").alias("value")),
        F.struct(F.lit(V.EQUITY).alias("key"), F.pmod(k, F.lit(2)).cast("double").alias("value")))
    truth = F.map_from_entries(F.filter(values, lambda e: (e["key"] != V.EQUITY) | (F.pmod(k, F.lit(3)) != 2)))
    return table(spark, sf_dir, "orders").where(c("o_orderstatus") != "P").select(
        F.concat(F.lit("doc_"), k.cast("string")).alias("stem"), truth.alias("truth"))


EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, probabilities per event; the scores are whole hundredths that lean to the label."""
    e = F.col("event_id")
    entries = [x for i, k in enumerate(EVENT_CLASSES) for x in (F.lit(k), (
        (F.pmod(e * (31 + 14 * i) + 17 * i, F.lit(101)) + F.when(F.col("event_type") == k, 20).otherwise(0)) / 200.0))]
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"),
                                                 F.create_map(*entries).alias("probabilities"))


def labelled_features(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """Model features of every supplier and month with nation group as sector and the Altman zone as class. The bags of a forest depend on
    the partitions of its rows, which `supplier_pairs` changes, so those pairs are taken only where they are given."""
    from ledgermill.operators.risk_model import statement_features
    from ledgermill.operators.scoring import altman
    from ledgermill.operators.statements import period_pairs
    scored = altman(period_pairs(supplier_statements(spark, sf_dir)) if pairs is None else pairs).withColumn("zone", F.col("altman.zone"))
    risk = (F.when(F.col("zone") == "Safe Zone", "Low").when(F.col("zone") == "Grey Zone", "Medium").otherwise("High"))
    sectors = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sectors = sectors.select(F.col("s_suppkey").alias("company"), cycle(F.col("n_regionkey"), list(V.SECTOR_FEATURES)).alias("sector"))
    rows = scored.withColumns({V.TARGET: risk, "PeriodeTahun": F.floor((F.col("period") - 1) / 12).cast("int"),
                               "UniqueID": F.concat_ws("_", "company", "period")}).drop("altman", "zone")
    return statement_features(rows.join(sectors, "company", "left"))


def order_risk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled features per order: the status as risk class (pending ones of 1997 without), three features, a sector of the customer."""
    c = F.col
    status = c("o_orderstatus")
    risk = F.when(status == "F", "High").when(status == "O", "Low").when(F.year("o_orderdate") != 1997, "Medium")
    lean = F.when(status == "F", 0.4).when(status == "O", 0.0).otherwise(0.2)
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").cast("string").alias("UniqueID"), risk.alias(V.TARGET), F.year("o_orderdate").alias("PeriodeTahun"),
        (c("o_totalprice") / 100000.0).alias("CurrentRatio"), (F.pmod(c("o_orderkey") * 7919, F.lit(100)) / 100.0 + lean).alias("DebtToEquityRatio"),
        F.when(F.pmod("o_custkey", F.lit(9)) != 0, F.pmod("o_custkey", F.lit(50)) / 50.0 - lean).alias("ROA"),
        cycle(c("o_custkey"), list(V.SECTOR_FEATURES)).alias(V.SECTOR))
