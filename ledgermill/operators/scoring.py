"""Altman Z, Beneish M, common ratios, growth and return ratios, and the combined record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.operators import boosting
from ledgermill.operators.risk_model import RiskModel, predict, statement_features
from ledgermill.operators.statements import ItemReader, above, canonical_map, period_pairs

NO_T1 = "Data t-1 tidak disediakan."
NO_T = "Data keuangan periode t (data_t) tidak valid atau kosong setelah normalisasi."


def altman_model(is_public: Column, override: Column) -> Column:
    return F.coalesce(override, F.when(is_public, F.lit(V.PUBLIC)).otherwise(F.lit(V.PRIVATE)))


def altman(table: DataFrame, is_public: Column | None = None, override: Column | None = None,
           market_value: Column | None = None, items: str = "items") -> DataFrame:
    """Add `altman`: STRUCT(z_score, x1..x5, x4_note, zone, interpretation, model_used, error).

    A market value replaces book equity in X4 for the public model, and for any model chosen by override.
    """
    none = F.lit(None)
    is_public = F.lit(True) if is_public is None else F.coalesce(is_public, F.lit(True))
    override = none.cast("string") if override is None else override
    market_value = none.cast("double") if market_value is None else market_value
    inputs = table.withColumns({
        "_model": altman_model(is_public, override),
        "_market": F.when(override.isNotNull() | is_public, market_value),
    })
    inputs, r = ItemReader.load(inputs, items, V.ALTMAN_REQUIRED, {V.EQUITY: F.col("_market")})
    numbers = inputs.withColumns({
        "_missing": r.first_missing(V.ALTMAN_REQUIRED),
        "_failed_text": r.first_failed([V.CURRENT_ASSETS, V.CURRENT_LIABILITIES, V.ASSETS, V.RETAINED, V.PRETAX,
                                        V.INTEREST, V.EQUITY, V.LIABILITIES, V.SALES]),
        "_working": r.number(V.CURRENT_ASSETS) - r.number(V.CURRENT_LIABILITIES),
        "_assets": r.number(V.ASSETS), "_retained": r.number(V.RETAINED),
        "_ebit": r.number(V.PRETAX) + r.number(V.INTEREST), "_equity": r.number(V.EQUITY),
        "_liabilities": r.number(V.LIABILITIES), "_sales": r.number(V.SALES),
    })
    known = F.col("_model").isin(*V.ALTMAN_MODELS)
    error = (
        F.when(F.col("_missing").isNotNull(), F.concat(F.lit("Missing item in data_t for Z-Score: "), F.col("_missing")))
        .when(F.col("_failed_text").isNotNull(), F.concat(
            F.lit("ValueError, data Z-Score tidak dapat dikonversi ke float: "), F.col("_failed_text")))
        .when(F.col("_assets") == 0, F.lit("Total Assets cannot be zero for Z-Score calculation."))
        .when(~known, F.concat(
            F.lit("Invalid model_type for Z-Score: "), F.col("_model"), F.lit(
                ". Valid types are 'public_manufacturing', 'private_manufacturing', "
                "'non_manufacturing_or_emerging_markets'.")))
    )
    checked = numbers.withColumn("_error", error)
    ok = F.col("_error").isNull()

    def over_assets(name: str) -> Column:
        return F.when(ok, F.col(name) / F.col("_assets"))
    parts = checked.withColumns({
        "_x1": over_assets("_working"), "_x2": over_assets("_retained"), "_x3": over_assets("_ebit"),
        "_x4": F.when(ok & (F.col("_liabilities") == 0), F.when(above(F.col("_equity"), 0.0), 10.0).otherwise(0.0))
        .when(ok, F.col("_equity") / F.col("_liabilities")),
        "_x5": over_assets("_sales"),
    })
    xs = [F.col(f"_x{i}") for i in range(1, 6)]

    def by_model(value) -> Column:
        out = None
        for name, spec in V.ALTMAN_MODELS.items():
            cond = F.col("_model") == name
            out = F.when(cond, value(spec)) if out is None else out.when(cond, value(spec))
        return out

    def total(spec) -> Column:
        out = None if spec[0] is None else F.lit(spec[0])
        for weight, x in zip(spec[1], xs):
            out = F.lit(weight) * x if out is None else out + F.lit(weight) * x
        return out
    z = parts.withColumn("_z", by_model(total))
    zone = (F.when(~ok, F.lit("Error"))
            .when(above(F.col("_z"), by_model(lambda s: F.lit(s[2]))), F.lit("Safe Zone"))
            .when(above(F.col("_z"), by_model(lambda s: F.lit(s[3]))), F.lit("Grey Zone"))
            .otherwise(F.lit("Distress Zone")))
    zoned = z.withColumn("_zone", zone)
    text = F.when(~ok, F.concat(F.lit("Error dalam perhitungan: "), F.col("_error"))).otherwise(F.concat(
        F.lit("Perusahaan berada di '"), F.col("_zone"), F.lit("'. Model: "), by_model(lambda s: F.lit(s[4])),
        F.lit(". Zona Detail: "), by_model(lambda s: F.lit(s[5]))))
    result = F.struct(
        F.col("_z").alias("z_score"), *[x.alias(f"x{i}") for i, x in enumerate(xs, 1)],
        F.when(ok, F.when(F.col("_market").isNotNull(), F.lit(V.MARKET_NOTE)).otherwise(F.lit(V.BOOK_NOTE)))
        .alias("x4_note"),
        F.col("_zone").alias("zone"), text.alias("interpretation"), F.col("_model").alias("model_used"),
        F.col("_error").alias("error"))
    return zoned.select(*table.columns, result.alias("altman"))


def _ratio_index(now: Column, before: Column) -> Column:
    """now / before; with before = 0: 1 if now is 0 too, else 2."""
    return F.when(before == 0, F.when(now == 0, 1.0).otherwise(2.0)).otherwise(now / before)


def beneish(pairs: DataFrame, items: str = "items", items_t1: str = "items_t1") -> DataFrame:
    """Add `beneish`: STRUCT(m_score, dsri, gmi, aqi, sgi, depi, sgai, lvgi, tata, interpretation, error)."""
    loaded, now = ItemReader.load(pairs, items, V.BENEISH_REQUIRED_T)
    loaded, old = ItemReader.load(loaded, items_t1, V.BENEISH_REQUIRED_T1)
    order_t = [V.RECEIVABLES, V.SALES, V.GROSS_PROFIT, V.ASSETS, V.DEPRECIATION, V.PPE_GROSS, V.SELLING, V.ADMIN,
               V.LIABILITIES, V.NET_INCOME, V.OPERATING_CASH, V.CURRENT_ASSETS, V.PPE_NET]
    order_t1 = [n for n in order_t if n not in (V.NET_INCOME, V.OPERATING_CASH)]
    error = F.coalesce(
        F.when(F.col(items_t1).isNull(), F.lit(NO_T1)),
        F.concat(F.lit("Missing item in data_t: "), now.first_missing(V.BENEISH_REQUIRED_T)),
        F.concat(F.lit("Missing item in data_t_minus_1: "), old.first_missing(V.BENEISH_REQUIRED_T1)),
        F.concat(F.lit("ValueError, data tidak dapat dikonversi ke float: "),
                 F.coalesce(now.first_failed(order_t), old.first_failed(order_t1))))
    names = {"rec": V.RECEIVABLES, "sales": V.SALES, "gross": V.GROSS_PROFIT, "assets": V.ASSETS,
             "dep": V.DEPRECIATION, "ppe": V.PPE_GROSS, "liab": V.LIABILITIES, "cur": V.CURRENT_ASSETS,
             "net_ppe": V.PPE_NET}
    cols = {"_error": error}
    for short, name in names.items():
        cols[f"_{short}"], cols[f"_{short}0"] = now.number(name), old.number(name)
    cols["_sga"] = now.number(V.SELLING) + now.number(V.ADMIN)
    cols["_sga0"] = old.number(V.SELLING) + old.number(V.ADMIN)
    cols["_income"], cols["_cfo"] = now.number(V.NET_INCOME), now.number(V.OPERATING_CASH)
    base = loaded.withColumns(cols)
    c = F.col
    no_sales = (c("_sales") == 0) | (c("_sales0") == 0)
    no_assets = (c("_assets") == 0) | (c("_assets0") == 0)
    steps = base.withColumns({
        "_gm": F.when(no_sales, 0.0).otherwise(c("_gross") / c("_sales")),
        "_gm0": F.when(no_sales, 0.0).otherwise(c("_gross0") / c("_sales0")),
        "_soft": F.when(~no_assets, 1 - (c("_cur") + c("_net_ppe")) / c("_assets")),
        "_soft0": F.when(~no_assets, 1 - (c("_cur0") + c("_net_ppe0")) / c("_assets0")),
        "_rate": F.when(c("_dep") + c("_ppe") == 0, 0.0).otherwise(c("_dep") / (c("_dep") + c("_ppe"))),
        "_rate0": F.when(c("_dep0") + c("_ppe0") == 0, 0.0).otherwise(c("_dep0") / (c("_dep0") + c("_ppe0"))),
        "_lev": F.when(~no_assets, c("_liab") / c("_assets")), "_lev0": F.when(~no_assets, c("_liab0") / c("_assets0")),
        "_cost": F.when(~no_sales, c("_sga") / c("_sales")), "_cost0": F.when(~no_sales, c("_sga0") / c("_sales0")),
        "_days0": F.when(~no_sales, c("_rec0") / c("_sales0")),
    })
    indices = {
        "dsri": F.when(no_sales | (c("_rec0") == 0) | (c("_days0") == 0), 1.0)
        .otherwise(c("_rec") / c("_sales") / c("_days0")),
        "gmi": F.when(c("_gm") == 0, 1.0).otherwise(c("_gm0") / c("_gm")),
        "aqi": F.when(no_assets, 1.0).otherwise(_ratio_index(c("_soft"), c("_soft0"))),
        "sgi": _ratio_index(c("_sales"), c("_sales0")),
        "depi": _ratio_index(c("_rate0"), c("_rate")),
        "sgai": F.when(no_sales, 1.0).otherwise(_ratio_index(c("_cost"), c("_cost0"))),
        "lvgi": F.when(no_assets, 1.0).otherwise(_ratio_index(c("_lev"), c("_lev0"))),
        "tata": F.when(c("_assets") == 0, 0.0).otherwise((c("_income") - c("_cfo")) / c("_assets")),
    }
    ok = c("_error").isNull()
    scored = steps.withColumns({f"_{k}": F.when(ok, v) for k, v in indices.items()})
    m = F.lit(V.BENEISH_CONSTANT)
    for name, weight in V.BENEISH_WEIGHTS:
        m = m + F.lit(weight) * c(f"_{name}")
    final = scored.withColumn("_m", m)
    text = (F.when(c("_error") == NO_T1, F.lit("Data periode t-1 tidak tersedia untuk Beneish M-Score."))
            .when(~ok, F.concat(F.lit("Error dalam perhitungan: "), c("_error")))
            .when(above(c("_m"), V.BENEISH_LIKELY), F.lit(V.BENEISH_TEXT[0]))
            .when(above(c("_m"), V.BENEISH_GREY), F.lit(V.BENEISH_TEXT[1]))
            .otherwise(F.lit(V.BENEISH_TEXT[2])))
    result = F.struct(c("_m").alias("m_score"), *[c(f"_{k}").alias(k) for k in indices],
                      text.alias("interpretation"), c("_error").alias("error"))
    return final.select(*pairs.columns, result.alias("beneish"))


def common_ratios(table: DataFrame, items: str = "items") -> DataFrame:
    """Add `ratios`: STRUCT of six ratios with their notes and one error. Infinite values are kept."""
    loaded, r = ItemReader.load(table, items, [*V.RATIO_REQUIRED, V.GROSS_PROFIT, V.ASSETS])
    checked = [V.LIABILITIES, V.EQUITY, V.CURRENT_ASSETS, V.CURRENT_LIABILITIES, V.PRETAX, V.INTEREST,
               V.NET_INCOME, V.SALES]
    base = loaded.withColumns({
        "_error": F.coalesce(
            F.concat(F.lit("Missing items in data_t for financial ratios: "), r.all_missing(V.RATIO_REQUIRED)),
            F.concat(F.lit("ValueError, data tidak dapat dikonversi ke float untuk rasio: "), r.first_failed(checked))),
        "_liab": r.number(V.LIABILITIES), "_eq": r.number(V.EQUITY), "_ca": r.number(V.CURRENT_ASSETS),
        "_cl": r.number(V.CURRENT_LIABILITIES), "_ebit": r.number(V.PRETAX) + r.number(V.INTEREST),
        "_int": r.number(V.INTEREST), "_net": r.number(V.NET_INCOME), "_sales": r.number(V.SALES),
        "_gross": r.number(V.GROSS_PROFIT), "_gross_bad": r.failed(V.GROSS_PROFIT),
        "_assets": r.number(V.ASSETS), "_assets_bad": r.failed(V.ASSETS),
    })
    c, ok = F.col, F.col("_error").isNull()
    inf = F.lit(float("inf"))

    def positive_or_zero(value: Column) -> Column:
        return F.when(above(value, 0.0), inf).otherwise(0.0)

    def note(cond: Column, text: str) -> Column:
        return F.when(ok & cond, F.lit(text))
    no_int = c("_int") == 0
    ratios = {
        "debt_to_equity": F.when(c("_eq") == 0, positive_or_zero(c("_liab"))).otherwise(c("_liab") / c("_eq")),
        "current_ratio": F.when(c("_cl") == 0, positive_or_zero(c("_ca"))).otherwise(c("_ca") / c("_cl")),
        "interest_coverage": F.when(
            no_int, F.when(above(c("_ebit"), 0.0), inf).when(c("_ebit") == 0, 0.0).otherwise(-inf))
        .otherwise(c("_ebit") / c("_int")),
        "net_margin": F.when(c("_sales") == 0, 0.0).otherwise(c("_net") / c("_sales")),
        "gross_margin": F.when(c("_gross").isNotNull(), F.when(c("_sales") == 0, 0.0).otherwise(c("_gross") / c("_sales"))),
        "debt_ratio": F.when(c("_assets").isNotNull(), F.when(c("_assets") == 0, positive_or_zero(c("_liab")))
                             .otherwise(c("_liab") / c("_assets"))),
    }
    notes = {
        "debt_to_equity_note": note(c("_eq") == 0, "Total Equity is zero."),
        "current_ratio_note": note(c("_cl") == 0, "Current Liabilities are zero."),
        "interest_coverage_note": F.coalesce(
            note(no_int & above(c("_ebit"), 0.0), "No interest expense, EBIT is positive."),
            note(no_int & (c("_ebit") == 0), "No interest expense, EBIT is zero."),
            note(no_int, "No interest expense, EBIT is negative.")),
        "net_margin_note": note(c("_sales") == 0, "Sales are zero."),
        "gross_margin_note": F.coalesce(
            note(c("_gross_bad"), "Could not calculate due to missing/invalid 'Laba bruto'."),
            note(c("_gross").isNotNull() & (c("_sales") == 0), "Sales are zero.")),
        "debt_ratio_note": F.coalesce(
            note(c("_assets_bad"), "Could not calculate due to missing/invalid 'Jumlah aset'."),
            note(c("_assets") == 0, "Total Assets are zero.")),
    }
    result = F.struct(*[F.when(ok, v).alias(k) for k, v in ratios.items()],
                      *[v.alias(k) for k, v in notes.items()], c("_error").alias("error"))
    return base.select(*table.columns, result.alias("ratios"))


def growth_returns(pairs: DataFrame, items: str = "items", items_t1: str = "items_t1") -> DataFrame:
    """Add `returns`: STRUCT(roe, roa_ebit, sales_growth); null where an input is absent or a divisor is 0."""
    loaded, now = ItemReader.load(pairs, items, [V.PRETAX, V.INTEREST, V.NET_INCOME, V.EQUITY, V.ASSETS, V.SALES])
    loaded, old = ItemReader.load(loaded, items_t1, [V.SALES])
    ebit = now.number(V.PRETAX) + now.number(V.INTEREST)
    return loaded.select(*pairs.columns, F.struct(
        F.try_divide(now.number(V.NET_INCOME), now.number(V.EQUITY)).alias("roe"),
        F.try_divide(ebit, now.number(V.ASSETS)).alias("roa_ebit"),
        (F.try_divide(now.number(V.SALES), old.number(V.SALES)) - 1).alias("sales_growth")).alias("returns"))


def combined_error(altman_: Column, beneish_: Column, has_t1: Column, ml_error: Column | None = None) -> Column:
    """One message: Altman first, then Beneish (only if t-1 was given), then the model."""
    parts = [
        F.concat(F.lit("Analisis Altman Z-Score gagal: "), altman_["error"]),
        F.when(has_t1, F.concat(F.lit("Analisis Beneish M-Score gagal: "), beneish_["error"])),
    ]
    if ml_error is not None:
        parts.append(F.concat(F.lit("Prediksi Risiko Kredit ML gagal: "), ml_error))
    return F.coalesce(*parts)


def credit_risk(scored: DataFrame, model: RiskModel | boosting.BoostedModel | None, sector: str = "sector") -> DataFrame:
    """Add `prediction`: STRUCT(risk_category, risk_score, probabilities, error) from the statement pair and its sector.

    Without a sector, and without a model, only the error is given. The record travels through the model as one column,
    so there is no join."""
    packed = scored.select("items", "items_t1", F.col(sector), F.struct(*scored.columns).alias("_record"))
    rate = boosting.predict if isinstance(model, boosting.BoostedModel) else predict
    rated = rate(statement_features(packed, sector), model, ["_record"])
    given = F.coalesce(F.col(f"_record.{sector}"), F.lit("")) != ""
    return rated.select("_record.*", F.struct(
        *[F.when(given, F.col(c)).alias(c) for c in ("risk_category", "risk_score", "probabilities")],
        F.when(given, F.col("error")).otherwise(F.lit(V.NO_SECTOR)).alias("error")).alias("prediction"))


def score_companies(table: DataFrame, requests: DataFrame | None = None, step: int = 1,
                    model: RiskModel | boosting.BoostedModel | None = None) -> DataFrame:
    """Combined record per company and period: item names cleaned, then altman, beneish, ratios, returns, with requests also
    the model's prediction, and one global error.

    `requests` may hold (company, is_public, market_value_equity, model_override, sector), one row per company.
    """
    pairs = period_pairs(table.withColumn("items", canonical_map(F.col("items"))), ("items",), step)
    if requests is not None:
        pairs = pairs.join(requests, "company", "left")
        args = (F.col("is_public"), F.col("model_override"), F.col("market_value_equity"))
    else:
        args = (None, None, None)
    scored = growth_returns(common_ratios(beneish(altman(pairs, *args))))
    if requests is not None:
        scored = credit_risk(scored, model)
    empty = F.coalesce(F.size("items"), F.lit(0)) <= 0
    return scored.withColumn("error", F.when(empty, F.lit(NO_T)).otherwise(
        combined_error(F.col("altman"), F.col("beneish"), F.col("items_t1").isNotNull(),
                       F.col("prediction.error") if requests is not None else None)))
