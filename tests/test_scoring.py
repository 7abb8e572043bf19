import pytest
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.operators import scoring as S
from ledgermill.operators.risk_model import train
from ledgermill.operators.statements import canonical_items, canonical_map, period_pairs, statements
from ledgermill.plans import derived as D

T = {V.SALES: 108.249, V.ASSETS: 101.003, V.LIABILITIES: 16.289, V.NET_INCOME: 21.661, V.CURRENT_ASSETS: 19.238,
     V.CURRENT_LIABILITIES: 14.3, V.RETAINED: 65.0, V.PRETAX: 22.136, V.INTEREST: 0.55, V.EQUITY: 84.714,
     V.GROSS_PROFIT: 10.511, V.PPE_GROSS: 66.0, V.DEPRECIATION: 2.75, V.SELLING: 3.3, V.ADMIN: 2.2,
     V.OPERATING_CASH: 3.135, V.PPE_NET: 55.0, V.NON_CURRENT_ASSETS: 81.765, V.RECEIVABLES: 13.2}
T1 = {V.SALES: 95.0, V.ASSETS: 93.0, V.LIABILITIES: 14.8, V.CURRENT_ASSETS: 18.0, V.GROSS_PROFIT: 10.0, V.PPE_GROSS: 60.0,
      V.DEPRECIATION: 2.5, V.SELLING: 3.0, V.ADMIN: 2.0, V.PPE_NET: 50.0, V.NON_CURRENT_ASSETS: 75.0, V.RECEIVABLES: 12.0}


def table(spark, *rows, value="double"):
    return spark.createDataFrame(list(rows), f"company string, period int, items map<string,{value}>")


def one(df, column):
    return df.select(f"{column}.*").first().asDict()


def beneish_of(spark, now, old):
    rows = table(spark, ("a", 2023, now), ("a", 2022, old))
    return one(S.beneish(period_pairs(rows)).where("period = 2023"), "beneish")


def without(d, *names, **changes):
    return {k: v for k, v in {**d, **changes}.items() if k not in names}


@pytest.mark.parametrize("override, market, z", [
    (None, None, 5.891915879929719), (V.PRIVATE, None, 4.531876974291645), (V.OTHER, None, 12.638755780382242),
    (None, 90.0, 6.086623965140598)])
def test_altman_models(spark, override, market, z):
    out = one(S.altman(table(spark, ("a", 1, T)), override=F.lit(override).cast("string"),
                       market_value=F.lit(market).cast("double")), "altman")
    assert out["z_score"] == pytest.approx(z, abs=1e-9) and out["zone"] == "Safe Zone" and out["error"] is None


def test_market_value_only_counts_for_public_or_override(spark):
    rows = table(spark, ("a", 1, T))
    private = one(S.altman(rows, is_public=F.lit(False), market_value=F.lit(90.0)), "altman")
    assert private["x4"] == pytest.approx(84.714 / 16.289) and private["model_used"] == V.PRIVATE
    forced = one(S.altman(rows, is_public=F.lit(False), override=F.lit(V.OTHER), market_value=F.lit(90.0)), "altman")
    assert forced["x4"] == pytest.approx(90 / 16.289)


@pytest.mark.parametrize("items, error", [
    (without(T, V.RETAINED, V.SALES), "Missing item in data_t for Z-Score: Laba ditahan"),
    ({**T, V.ASSETS: 0.0}, "Total Assets cannot be zero for Z-Score calculation."),
    ({**T, V.EQUITY: None}, "ValueError, data Z-Score tidak dapat dikonversi ke float: nilai kosong: Jumlah ekuitas")])
def test_altman_errors(spark, items, error):
    out = one(S.altman(table(spark, ("a", 1, items))), "altman")
    assert out["error"] == error and out["zone"] == "Error" and out["z_score"] is None


def test_text_items_and_nan(spark):
    text = {k: str(v) for k, v in T.items()}
    assert one(S.altman(table(spark, ("a", 1, text), value="string")), "altman")["z_score"] == pytest.approx(5.891915879929719)
    bad = one(S.altman(table(spark, ("a", 1, {**text, V.SALES: "12d"}), value="string")), "altman")
    assert bad["error"].endswith("could not convert string to float: '12d'")
    nan = one(S.altman(table(spark, ("a", 1, {**T, V.SALES: float("nan")}))), "altman")
    assert nan["zone"] == "Distress Zone"


def test_zero_liabilities(spark):
    assert one(S.altman(table(spark, ("a", 1, {**T, V.LIABILITIES: 0.0}))), "altman")["x4"] == 10.0
    assert one(S.altman(table(spark, ("a", 1, {**T, V.LIABILITIES: 0.0, V.EQUITY: -1.0}))), "altman")["x4"] == 0.0


def test_beneish_values(spark):
    out = beneish_of(spark, T, T1)
    expected = dict(m_score=-1.489024128986188, dsri=.9653668856063334, gmi=1.0840673179476137, aqi=.9857707196815935,
                    sgi=1.1394631578947367, depi=1.0, sgai=.9653668856063337, lvgi=1.0134011272343797, tata=.1834202944466996)
    assert {k: out[k] for k in expected} == pytest.approx(expected, abs=1e-9)
    other = beneish_of(spark, T, {**T1, V.CURRENT_ASSETS: 1.8})
    assert (other["m_score"], other["aqi"]) == pytest.approx((-1.6456181145728896, .5981618444669864), abs=1e-9)


def test_beneish_zero_branches(spark):
    zero_now = beneish_of(spark, {**T, V.SALES: 0.0, V.GROSS_PROFIT: 0.0}, T1)
    assert (zero_now["dsri"], zero_now["gmi"], zero_now["sgai"], zero_now["sgi"]) == (1.0, 1.0, 1.0, 0.0)
    zero_old = beneish_of(spark, T, {**T1, V.SALES: 0.0, V.GROSS_PROFIT: 0.0})
    assert (zero_old["dsri"], zero_old["gmi"], zero_old["sgi"], zero_old["sgai"]) == (1.0, 1.0, 2.0, 1.0)
    assert beneish_of(spark, T, {**T1, V.CURRENT_ASSETS: 43.0})["aqi"] == 2.0
    assert beneish_of(spark, {**T, V.DEPRECIATION: 0.0}, T1)["depi"] == 2.0
    assert beneish_of(spark, T, {**T1, V.ASSETS: 0.0})["lvgi"] == 1.0
    assert beneish_of(spark, T, {**T1, V.LIABILITIES: 0.0})["lvgi"] == 2.0
    assert beneish_of(spark, without(T, V.RECEIVABLES), T1)["error"] == "Missing item in data_t: Piutang usaha"
    assert beneish_of(spark, T, without(T1, V.ADMIN))["error"] == f"Missing item in data_t_minus_1: {V.ADMIN}"


def test_ratios(spark):
    out = one(S.common_ratios(table(spark, ("a", 1, T))), "ratios")
    assert [out[k] for k in ("debt_to_equity", "current_ratio", "interest_coverage", "net_margin", "gross_margin", "debt_ratio")] \
        == pytest.approx([.1922822673938192, 1.3453146853146853, 41.24727272727273, .2001034651590315, .09710020415892988,
                          .1612724374523529], abs=1e-9)
    odd = one(S.common_ratios(table(spark, ("a", 1, {**T, V.EQUITY: 0.0, V.CURRENT_LIABILITIES: 0.0, V.INTEREST: 0.0,
                                                     V.PRETAX: -1.0, V.SALES: 0.0}))), "ratios")
    assert odd["debt_to_equity"] == odd["current_ratio"] == float("inf") and odd["interest_coverage"] == float("-inf")
    assert odd["net_margin"] == 0.0 and odd["net_margin_note"] == "Sales are zero."
    gap = one(S.common_ratios(table(spark, ("a", 1, without(T, V.INTEREST, V.EQUITY)))), "ratios")
    assert gap["error"] == "Missing items in data_t for financial ratios: Jumlah ekuitas, Beban bunga"
    optional = one(S.common_ratios(table(spark, ("a", 1, without(T, V.GROSS_PROFIT, V.ASSETS)))), "ratios")
    assert optional["error"] is None and optional["gross_margin"] is None and optional["debt_ratio"] is None


def test_published_parity_case(spark):
    """The stored extraction with its older item names gives the stored scores."""
    t = {"Jumlah aset lancar": 19238e9, "Jumlah aset tidak lancar": 81765e9, "Jumlah liabilitas jangka pendek": 14300e9,
         "Jumlah liabilitas": 14300e9, "Jumlah ekuitas": 84714e9, "Pendapatan bersih": 108249e9, "Laba bruto": 10511e9,
         "Laba sebelum pajak penghasilan": 22136e9, "Laba tahun berjalan": 21661e9, "Jumlah aset": 19238e9,
         "Piutang usaha": 1e9, "Aset tetap bruto": 15697e9, "Laba ditahan": 425e9, "Beban bunga": -119e9,
         "Beban penjualan": -5298e9, "Beban administrasi dan umum": 322e9}
    rows = table(spark, ("x", 2, t), ("x", 1, {"Pendapatan bersih": 106427e9})).withColumn(
        "items", canonical_map(F.col("items"), {**V.ALIASES, **V.OLDER_ALIASES}))
    out = S.score_companies(rows).where("period = 2").select("altman.z_score", "ratios.current_ratio", "ratios.debt_to_equity",
                                                             "ratios.debt_ratio", "ratios.net_margin", "returns.*", "beneish.error").first()
    assert out["z_score"] == pytest.approx(13.29127996418801, abs=1e-9)
    assert tuple(out)[1:8] == pytest.approx((1.3453146853146853, 0.16880326746464575, 0.7433205114876806, 0.2001034651590315,
                                             0.2556956347238945, 1.1444536854142842, 0.01711971586157648), abs=1e-9)
    assert out["error"] == "Missing item in data_t: Beban penyusutan"


def test_pairs_do_not_bridge_gaps(spark):
    rows = period_pairs(table(spark, ("a", 2020, T), ("a", 2022, T), ("a", 2023, T), ("b", 2021, T)))
    assert {(r.company, r.period): r.items_t1 is not None for r in rows.collect()} == {
        ("a", 2020): False, ("a", 2022): False, ("a", 2023): True, ("b", 2021): False}


def test_repeated_statements_stay_and_share_one_earlier_period(spark):
    rows = table(spark, ("a", 2022, T1), ("a", 2022, {**T1, V.SALES: 1.0}), ("a", 2023, T), ("a", 2023, {**T, V.SALES: 2.0}))
    out = [(r["items"][V.SALES], r.items_t1 and r.items_t1[V.SALES]) for r in period_pairs(rows).collect()]
    assert sorted(now for now, _ in out) == [1.0, 2.0, 95.0, 108.249]
    old = {o for now, o in out if now in (2.0, 108.249)}
    assert len(old) == 1 and old <= {1.0, 95.0}
    again = period_pairs(rows.repartition(3)).where("period = 2023").collect()
    assert {r.items_t1[V.SALES] for r in again} == old


def test_combined_record_cleans_names_and_predicts(spark):
    other = {("Total Aset" if k == V.ASSETS else k): v for k, v in T.items()}
    rows = table(spark, ("a", 2, other), ("a", 1, T1))
    assert S.score_companies(rows).where("period = 2").first()["altman"]["error"] is None
    requests = spark.createDataFrame([("a", True, None, None, "Agro")],
                                     "company string, is_public boolean, market_value_equity double, model_override string, sector string")
    sample = spark.range(20).select((F.col("id") / 10).alias("CurrentRatio"), F.lit("Agro").alias(V.SECTOR),
                                    F.when(F.col("id") < 10, "High").otherwise("Low").alias(V.TARGET))
    out = S.score_companies(rows, requests, model=train(sample)).where("period = 2").first()
    assert out["prediction"]["risk_category"] in ("High", "Low") and out["prediction"]["error"] is None and out["error"] is None
    assert sum(out["prediction"]["probabilities"].values()) == pytest.approx(1.0) and out["altman"]["z_score"] is not None


def test_global_error_order(spark):
    requests = spark.createDataFrame([("a", True, None, None, "Agro"), ("b", True, None, None, None)],
                                     "company string, is_public boolean, market_value_equity double, model_override string, sector string")
    rows = table(spark, ("a", 2, T), ("a", 1, T1), ("b", 2, T), ("c", 2, {}))
    errors = {(r.company, r.period): r.error for r in S.score_companies(rows, requests).collect()}
    assert errors[("a", 2)] == f"Prediksi Risiko Kredit ML gagal: {V.MODEL_NOT_LOADED}" and errors[("c", 2)] == S.NO_T
    assert errors[("a", 1)].startswith("Analisis Altman Z-Score gagal: Missing item")
    assert errors[("b", 2)].startswith("Prediksi Risiko Kredit ML gagal: Sektor")


def test_canonical_names_keep_the_latest_entry(spark):
    long = spark.createDataFrame([("a", 1, "Total Aset", 1, 5.0), ("a", 1, "JUMLAH ASET", 2, 6.0), ("a", 1, "Lain", 3, 7.0)],
                                 "company string, period int, item string, pos int, value double")
    assert {(r.item, r.value) for r in canonical_items(long).collect()} == {("Jumlah aset", 6.0), ("Lain", 7.0)}
    assert statements(long).first()["items"] == {"Jumlah aset": 6.0, "Lain": 7.0}
    assert len(V.ALIASES) == 54


def test_whole_numbers_are_rounded_as_round_does(spark):
    values = [None, 0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 0.1 * 3, 114.99999999999999, 4503599627370497.5, 1e15 + 0.5, -7.5000001]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(D.whole(F.col("v")).alias("a"), F.round("v").cast("bigint").alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_pairs_of_sums_are_the_pairs_of_the_statements(spark, tmp_path):
    """The earlier period is found for the sums, and no map is shuffled or sorted for it."""
    rows = [(k, m, 10.0 + i, 100.005 * i, 0.05, 0.02 if i % 4 else None, "RAN"[i % 3], "OF"[i % 2])
            for i, (k, m) in enumerate((k, m) for k in (1, 2, None) for m in ("1995-01-03", "1995-02-28", "1995-04-01", None) for _ in range(2))]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    pairs = D.supplier_pairs(spark, str(tmp_path))
    expected = period_pairs(D.supplier_statements(spark, str(tmp_path)))
    assert pairs.dtypes == expected.dtypes and sorted(map(str, pairs.collect())) == sorted(map(str, expected.collect()))
    assert pairs.where("items_t1 IS NOT NULL").count() > 2
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan[plan.index("Window"):]
