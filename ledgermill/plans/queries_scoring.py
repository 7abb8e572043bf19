"""Registered queries over statements: scoring, item names, models and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.operators import boosting, risk_model as rm
from ledgermill.operators.evaluation import class_report, distribution
from ledgermill.operators.incremental import hash_split
from ledgermill.operators.outlook import sector_outlook
from ledgermill.operators.scoring import altman, beneish, common_ratios, growth_returns, score_companies
from ledgermill.operators.statements import canonical_items, canonical_map, period_pairs, statements
from ledgermill.plans import derived as D
from ledgermill.session import materialise

ALTMAN_COLUMNS = ["z_score", "x1", "x2", "x3", "x4", "x5", "zone"]


def _altman(spark: SparkSession, sf: str, **arguments) -> DataFrame:
    scored = altman(D.supplier_statements(spark, sf), **arguments)
    return scored.select("company", "period", *[F.col(f"altman.{c}").alias(c) for c in ALTMAN_COLUMNS], "altman.model_used")


def altman_public(spark: SparkSession, sf: str) -> DataFrame:
    return _altman(spark, sf)


def altman_private(spark: SparkSession, sf: str) -> DataFrame:
    return _altman(spark, sf, is_public=F.lit(False))


def altman_other(spark: SparkSession, sf: str) -> DataFrame:
    return _altman(spark, sf, override=F.lit(V.OTHER))


def altman_mve(spark: SparkSession, sf: str) -> DataFrame:
    """Model by override or flag, with a market value for some periods."""
    p = F.col("period")
    return _altman(spark, sf, is_public=F.pmod(p, F.lit(2)) == 0,
                   override=F.when(F.pmod(p, F.lit(5)) == 0, F.lit(V.PRIVATE)),
                   market_value=F.when(F.pmod(p, F.lit(3)) == 0, (p * 100).cast("double")))


def zone_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: companies per period and Altman zone."""
    scored = altman(D.supplier_statements(spark, sf))
    return scored.groupBy("period", F.col("altman.zone").alias("zone")).agg(F.count(F.lit(1)).alias("companies"))


def beneish_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = beneish(D.supplier_pairs(spark, sf))
    return scored.select("company", "period", *[F.col(f"beneish.{c}").alias(c) for c in (
        "m_score", "dsri", "gmi", "aqi", "sgi", "depi", "sgai", "lvgi", "tata", "interpretation")])


def _split_infinite(name: str) -> list[Column]:
    value = F.col(f"ratios.{name}")
    return [F.when(F.abs(value) < float("inf"), value).alias(name),
            F.when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise("finite").alias(f"{name}_kind")]


def ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    scored = common_ratios(D.supplier_statements(spark, sf))
    return scored.select("company", "period", *_split_infinite("debt_to_equity"), *_split_infinite("current_ratio"),
                         *_split_infinite("interest_coverage"), "ratios.net_margin", "ratios.gross_margin",
                         "ratios.debt_ratio", "ratios.debt_to_equity_note", "ratios.current_ratio_note")


def growth_table(spark: SparkSession, sf: str) -> DataFrame:
    return growth_returns(D.supplier_pairs(spark, sf)).select("company", "period", "returns.*")


GAP_RULES = [(V.INTEREST, "company", 5), (V.EQUITY, "period", 7), (V.SALES, "company", 9), (V.DEPRECIATION, "period", 4)]


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    def kept(name: Column) -> Column:
        out = F.lit(True)
        for item, column, modulo in GAP_RULES:
            out = out & ~((name == item) & (F.pmod(F.col(column), F.lit(modulo)) == 0))
        return out
    return D.supplier_statements(spark, sf).withColumn("items", F.map_filter("items", lambda k, v: kept(k)))


def missing_items(spark: SparkSession, sf: str) -> DataFrame:
    scored = common_ratios(beneish(altman(period_pairs(_gappy(spark, sf)))))
    return scored.select("company", "period", F.col("altman.error").alias("altman_error"), F.col("beneish.error").alias(
        "beneish_error"), F.col("ratios.error").alias("ratio_error"))


def coercion_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Items as text with broken and unusual numbers."""
    c, k = F.col, F.pmod("company", F.lit(6))
    broken = (F.when(k == 0, "12d").when(k == 1, " 1_000 ").when(k == 2, "-1.5e3").when(k == 3, "").when(k == 4, ".5")
              .otherwise("1,000"))
    texts = D.supplier_statements(spark, sf).withColumn(
        "items", F.transform_values("items", lambda n, v: F.when(n == V.RETAINED, broken).otherwise(F.lit("7"))))
    return altman(texts).select("company", "period", c("altman.z_score").alias("z_score"), c("altman.error").alias("error"))


def _combined(spark: SparkSession, sf: str, model=None) -> DataFrame:
    s = F.col("s_suppkey")
    requests = D.table(spark, sf, "supplier").select(
        s.alias("company"), (F.pmod(s, F.lit(2)) == 0).alias("is_public"),
        F.when(F.pmod(s, F.lit(3)) == 0, F.col("s_acctbal")).alias("market_value_equity"),
        F.when(F.pmod(s, F.lit(4)) == 1, F.lit(V.OTHER)).alias("model_override"),
        F.when(F.pmod(s, F.lit(5)) != 0, F.lit("Agro")).alias("sector"))
    older = F.when(F.pmod("company", F.lit(2)) == 0, F.lit("Total Aset")).otherwise(F.lit("JUMLAH ASET"))
    aliased = _gappy(spark, sf).withColumn("items", F.transform_keys("items", lambda k, v: F.when(k == V.ASSETS, older).otherwise(k)))
    return score_companies(aliased, requests, model=model)


def combined_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = _combined(spark, sf)                          # no model is loaded, which is the last of the errors
    return out.select("company", "period", F.col("altman.z_score").alias("z_score"), F.col("altman.zone").alias("zone"),
                      F.col("altman.model_used").alias("model_used"), F.col("beneish.m_score").alias("m_score"),
                      F.col("ratios.net_margin").alias("net_margin"), "error")


def combined_with_model(spark: SparkSession, sf: str) -> DataFrame:
    """The combined record with trees fitted to the Altman zones: what holds for any model is compared, its class is not."""
    model = boosting.train(D.labelled_features(spark, sf, D.supplier_pairs(spark, sf)), rounds=2, depth=3, rate=0.3)
    out, p = _combined(spark, sf, model), F.col("prediction")
    points = F.create_map(*[F.lit(x) for pair in V.RISK_POINTS.items() for x in pair])
    shares = F.map_values(p["probabilities"])
    return out.select("company", "period", F.col("beneish.m_score").alias("m_score"), "error", p["error"].alias("model_error"),
                      F.coalesce(p["risk_score"] == F.try_element_at(points, p["risk_category"]), F.lit(False)).alias("rated"),
                      F.coalesce((F.size(shares) == 3) & (F.abs(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9)
                                 & (F.array_max(shares) == F.try_element_at(p["probabilities"], p["risk_category"])), F.lit(False)).alias("shares"))


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Model features of all statements as declared: known numeric ones, absent ones as null, the sector or 'Unknown'."""
    return rm.select_features(D.labelled_features(spark, sf).drop("RiskCategory", "PeriodeTahun"), ["UniqueID"]).select(
        "UniqueID", "CurrentRatio", "DebtToEquityRatio", "NetProfitMargin", "AssetTurnover", "InterestCoverageRatio", "SalesGrowth",
        F.col(V.NUMERIC_FEATURES[-1]).alias("absent"), V.SECTOR)


ALIAS_NAMES = ["Total Aset", "JUMLAH ASET", "Laba Bersih", "LABA TAHUN BERJALAN", "Pos lain", "Penjualan Bersih"]


def _order_items(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("company"), F.year("o_orderdate").cast("bigint").alias("period"),
        D.cycle(F.col("o_orderkey"), ALIAS_NAMES).alias("item"), F.col("o_orderkey").alias("pos"),
        F.col("o_totalprice").alias("value"))


def alias_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_items(_order_items(spark, sf)).select("company", "period", "item", "value")


def statement_maps(spark: SparkSession, sf: str) -> DataFrame:
    built = statements(_order_items(spark, sf))
    return built.select("company", "period", F.size("items").cast("bigint").alias("item_count"),
                        F.try_element_at("items", F.lit(V.ASSETS)).alias("assets"))


def alias_map(spark: SparkSession, sf: str) -> DataFrame:
    """Map form: of two names of one item the later entry wins."""
    k = F.col("o_orderkey")
    items = F.map_from_arrays(F.array(F.lit("Total Aset"), D.cycle(k, ["JUMLAH ASET", "Laba Kotor", "Pos lain"])),
                              F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double")))
    rows = D.table(spark, sf, "orders").select("o_orderkey", canonical_map(items).alias("items"))
    return rows.select("o_orderkey", F.size("items").cast("bigint").alias("item_count"),
                       F.try_element_at("items", F.lit(V.ASSETS)).alias("assets"))


def outlook_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    labels = ["Rendah", "Menengah", "Tinggi", "Menengah ke Tinggi"]
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    outlook = places.where(F.col("r_name") != "ASIA").select(
        F.col("r_name").alias("industry_main"), F.col("n_name").alias("industry_sub"),
        D.cycle(F.col("n_nationkey"), labels).alias("outlook"))
    k = F.pmod("c_custkey", F.lit(7))
    applicants = D.table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.when(k == 0, "").when(k == 1, None).otherwise(F.col("r_name")).alias("industry_main"),
        F.when(k == 2, "").when(k == 3, None).otherwise(F.col("n_name")).alias("industry_sub"))
    return sector_outlook(applicants, outlook).select("c_custkey", "outlook")


def order_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("order_year"))
    return distribution(rows, ["o_orderstatus", "o_orderpriority", "order_year"])


def event_class_report(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    guess = F.when(F.pmod(e, F.lit(3)) == 0, F.col("event_type")).otherwise(D.cycle(e * 7, D.EVENT_CLASSES[:4]))
    rows = D.table(spark, sf, "events").select(F.col("event_type").alias("label"), guess.alias("prediction"))
    out = class_report(rows, D.EVENT_CLASSES)
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score")], "support")


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def scale_features(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population deviation; the discount counts as missing where the tax is 0."""
    rows = D.table(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_tax") > 0, F.col("l_discount")))
    return rm.fit_scale(rows, SCALED).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def train_predict(spark: SparkSession, sf: str) -> DataFrame:
    data = materialise(D.labelled_features(spark, sf))
    fitted, held = hash_split(data, "UniqueID")
    return rm.predict(held, rm.train(fitted), ["UniqueID", V.TARGET])


def staged_update(spark: SparkSession, sf: str) -> DataFrame:
    """Initial sectors, then a new sector, new years and the other sectors; predictions of the last model."""
    data = materialise(D.labelled_features(spark, sf))
    sectors = list(V.SECTOR_FEATURES)
    initial = rm.slice_rows(data, sectors[:2], last_year=1997)
    model, _ = rm.staged_training(data, initial, [
        ("new_sector", rm.slice_rows(data, sectors[2:3], last_year=1997)),
        ("new_years", rm.slice_rows(data, sectors[:3], first_year=1998)),
        ("other_sectors", rm.slice_rows(data, sectors[3:]))])
    return rm.predict(data, model, ["UniqueID", V.TARGET])


def sector_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions for one row per sector, by a model of all rows."""
    data = materialise(D.labelled_features(spark, sf))
    return rm.sample_predictions(data, rm.train(data), keep=[V.TARGET])


def model_choice(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.supplier_statements(spark, sf)
    return altman(rows, override=D.cycle(F.col("company"), [V.PUBLIC, V.PRIVATE, V.OTHER, "unknown_model"])).select(
        "company", "period", "altman.zone", "altman.model_used", F.col("altman.error").isNull().alias("accepted"))


QUERIES = {f.__name__: f for f in (
    altman_public, altman_private, altman_other, altman_mve, zone_counts, beneish_scores, ratio_table, growth_table,
    missing_items, coercion_errors, combined_scores, combined_with_model, feature_rows, alias_canonical, statement_maps, alias_map, outlook_lookup,
    order_distribution, event_class_report, scale_features, train_predict, staged_update, sector_samples, model_choice)}
