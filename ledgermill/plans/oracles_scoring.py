"""The statement queries once more in DuckDB SQL, written from the definitions."""

from __future__ import annotations

from ledgermill import fixed_values as V

TOTALS = """
tot AS (
  SELECT company, period, sum(cents) AS gross, sum(CASE WHEN rf = 'R' THEN cents ELSE 0 END) AS ret,
         sum(CASE WHEN rf = 'A' THEN cents ELSE 0 END) AS acc, sum(CASE WHEN ls = 'O' THEN cents ELSE 0 END) AS opn,
         sum(cents * (100 - d)) AS sal, sum(cents * x) AS tax, sum(cents * d) AS dis, sum(q) AS qty
  FROM (SELECT l_suppkey AS company, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS period,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS d,
               CAST(round(l_tax * 100) AS BIGINT) AS x, CAST(round(l_quantity) AS BIGINT) AS q,
               l_returnflag AS rf, l_linestatus AS ls FROM lineitem)
  GROUP BY company, period),
st AS (
  SELECT company, period, CAST(sal AS DOUBLE) / 10000 AS sales, CAST(opn AS DOUBLE) / 100 AS ca,
         CAST(ret AS DOUBLE) / 100 AS cl, CAST(gross + acc AS DOUBLE) / 100 AS ta, CAST(ret + acc AS DOUBLE) / 100 AS tl,
         CAST(gross - ret AS DOUBLE) / 100 AS eq, CAST(sal - ret * 100 AS DOUBLE) / 10000 AS re,
         CAST(tax AS DOUBLE) / 10000 AS intr, CAST(dis * 4 - tax AS DOUBLE) / 10000 AS ebt, CAST(acc AS DOUBLE) / 100 AS rec,
         CAST(sal - qty * 10000000 AS DOUBLE) / 10000 AS gp, CAST(dis AS DOUBLE) / 10000 AS ni,
         CAST(tax AS DOUBLE) / 10000 AS sell, CAST(qty AS DOUBLE) AS adm, CAST(qty AS DOUBLE) AS dep,
         CAST(gross AS DOUBLE) / 100 AS ppe, CAST(gross - ret AS DOUBLE) / 100 AS ppn, CAST(opn AS DOUBLE) / 1000 AS cfo
  FROM tot)"""

PUB, PRI, OTH = "'public_manufacturing'", "'private_manufacturing'", "'non_manufacturing_or_emerging_markets'"
Z = {
    PUB: "1.2e0 * x1 + 1.4e0 * x2 + 3.3e0 * x3 + 0.6e0 * x4 + 0.999e0 * x5",
    PRI: "0.717e0 * x1 + 0.847e0 * x2 + 3.107e0 * x3 + 0.42e0 * x4 + 0.998e0 * x5",
    OTH: "3.25e0 + 6.56e0 * x1 + 3.26e0 * x2 + 6.72e0 * x3 + 1.05e0 * x4",
}
BOUNDS = {PUB: (2.99, 1.81), PRI: (2.90, 1.23), OTH: (2.60, 1.10)}


def _altman_ctes(model: str, equity: str = "eq", source: str = "st") -> str:
    z = " ".join(f"WHEN model_used = {m} THEN {f}" for m, f in Z.items())
    zone = " ".join(f"WHEN model_used = {m} THEN CASE WHEN z_score > {a}e0 THEN 'Safe Zone' WHEN z_score > {b}e0 "
                    f"THEN 'Grey Zone' ELSE 'Distress Zone' END" for m, (a, b) in BOUNDS.items())
    return f"""
xs AS (
  SELECT *, (ca - cl) / ta AS x1, re / ta AS x2, (ebt + intr) / ta AS x3,
         CASE WHEN tl = 0 THEN CASE WHEN eqv > 0 THEN 10e0 ELSE 0e0 END ELSE eqv / tl END AS x4, sales / ta AS x5
  FROM (SELECT *, {model} AS model_used, {equity} AS eqv FROM {source})),
zs AS (SELECT *, CASE {z} END AS z_score FROM xs),
zz AS (SELECT *, CASE {zone} END AS zone FROM zs)"""


def _altman(model: str, equity: str = "eq") -> str:
    return (f"WITH {TOTALS}, {_altman_ctes(model, equity)} SELECT company, period, z_score, x1, x2, x3, x4, x5, zone, "
            "model_used FROM zz")


MVE_MODEL = f"CASE WHEN period % 5 = 0 THEN {PRI} WHEN period % 2 = 0 THEN {PUB} ELSE {PRI} END"
MVE_EQUITY = ("CASE WHEN (period % 5 = 0 OR period % 2 = 0) AND period % 3 = 0 THEN CAST(period * 100 AS DOUBLE) "
              "ELSE eq END")


def _index(now: str, old: str) -> str:
    return f"CASE WHEN {old} = 0 THEN CASE WHEN {now} = 0 THEN 1e0 ELSE 2e0 END ELSE ({now}) / ({old}) END"


BENEISH = f"""
pair AS (
  SELECT a.*, b.company IS NOT NULL AS has_old, b.rec AS rec0, b.sales AS sales0, b.gp AS gp0, b.ta AS ta0, b.dep AS dep0,
         b.ppe AS ppe0, b.sell AS sell0, b.adm AS adm0, b.tl AS tl0, b.ca AS ca0, b.ppn AS ppn0
  FROM st a LEFT JOIN st b ON a.company = b.company AND a.period = b.period + 1),
mid AS (
  SELECT *, CASE WHEN sales = 0 OR sales0 = 0 THEN 0e0 ELSE gp / sales END AS gm,
         CASE WHEN sales = 0 OR sales0 = 0 THEN 0e0 ELSE gp0 / sales0 END AS gm0,
         1 - (ca + ppn) / ta AS soft, 1 - (ca0 + ppn0) / ta0 AS soft0,
         CASE WHEN dep + ppe = 0 THEN 0e0 ELSE dep / (dep + ppe) END AS rate,
         CASE WHEN dep0 + ppe0 = 0 THEN 0e0 ELSE dep0 / (dep0 + ppe0) END AS rate0,
         (sell + adm) / sales AS cost, (sell0 + adm0) / sales0 AS cost0, tl / ta AS lev, tl0 / ta0 AS lev0
  FROM pair),
ind AS (
  SELECT company, period, has_old,
         CASE WHEN NOT has_old THEN NULL WHEN sales = 0 OR sales0 = 0 OR rec0 = 0 THEN 1e0
              ELSE (rec / sales) / (rec0 / sales0) END AS dsri,
         CASE WHEN NOT has_old THEN NULL WHEN gm = 0 THEN 1e0 ELSE gm0 / gm END AS gmi,
         CASE WHEN NOT has_old THEN NULL WHEN ta = 0 OR ta0 = 0 THEN 1e0 ELSE {_index('soft', 'soft0')} END AS aqi,
         CASE WHEN NOT has_old THEN NULL ELSE {_index('sales', 'sales0')} END AS sgi,
         CASE WHEN NOT has_old THEN NULL ELSE {_index('rate0', 'rate')} END AS depi,
         CASE WHEN NOT has_old THEN NULL WHEN sales = 0 OR sales0 = 0 THEN 1e0 ELSE {_index('cost', 'cost0')} END AS sgai,
         CASE WHEN NOT has_old THEN NULL WHEN ta = 0 OR ta0 = 0 THEN 1e0 ELSE {_index('lev', 'lev0')} END AS lvgi,
         CASE WHEN NOT has_old THEN NULL WHEN ta = 0 THEN 0e0 ELSE (ni - cfo) / ta END AS tata
  FROM mid),
ben AS (
  SELECT *, -4.84e0 + 0.92e0 * dsri + 0.528e0 * gmi + 0.404e0 * aqi + 0.892e0 * sgi + 0.115e0 * depi
            - 0.172e0 * sgai + 4.679e0 * tata - 0.327e0 * lvgi AS m_score FROM ind)"""

ALTMAN_GAP = """CASE WHEN company % 5 = 0 THEN 'Missing item in data_t for Z-Score: Beban bunga'
  WHEN period % 7 = 0 THEN 'Missing item in data_t for Z-Score: Jumlah ekuitas'
  WHEN company % 9 = 0 THEN 'Missing item in data_t for Z-Score: Pendapatan bersih' END"""
BENEISH_GAP = """CASE WHEN NOT has_old THEN 'Data t-1 tidak disediakan.'
  WHEN company % 9 = 0 THEN 'Missing item in data_t: Pendapatan bersih'
  WHEN period % 4 = 0 THEN 'Missing item in data_t: Beban penyusutan'
  WHEN (period - 1) % 4 = 0 THEN 'Missing item in data_t_minus_1: Beban penyusutan' END"""

ALIAS_ROWS = """
rows AS (
  SELECT o_custkey AS company, CAST(year(o_orderdate) AS BIGINT) AS period, o_orderkey AS pos, o_totalprice AS value,
         CASE o_orderkey % 6 WHEN 0 THEN 'Jumlah aset' WHEN 1 THEN 'Jumlah aset' WHEN 2 THEN 'Laba/rugi tahun berjalan'
              WHEN 3 THEN 'Laba/rugi tahun berjalan' WHEN 4 THEN 'Pos lain' ELSE 'Pendapatan bersih' END AS item
  FROM orders),
kept AS (SELECT company, period, item, arg_max(value, pos) AS value FROM rows GROUP BY company, period, item)"""

CLASSES = ["click", "error", "purchase", "signup", "view"]
REPORT = f"""
WITH r AS (SELECT event_type AS label, CASE WHEN event_id % 3 = 0 THEN event_type
             ELSE ['click', 'error', 'purchase', 'signup'][CAST((event_id * 7) % 4 AS INT) + 1] END AS prediction FROM events),
c AS (SELECT class, (SELECT count(*) FROM r WHERE label = class AND prediction = class) AS tp,
             (SELECT count(*) FROM r WHERE prediction = class) AS predicted, (SELECT count(*) FROM r WHERE label = class) AS support
      FROM (SELECT unnest({CLASSES!r}) AS class)),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0e0 ELSE tp / predicted END AS p, CASE WHEN support = 0 THEN 0e0 ELSE tp / support END AS r
      FROM c),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * (p * r) / (p + r) END AS f1 FROM m)
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1_score, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9),
  round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f"""


def _scale(name: str, expr: str) -> str:
    return f"SELECT '{name}' AS feature, round(avg({expr}), 6) AS mean, round(stddev_pop({expr}), 6) AS std FROM lineitem"


COMBINED = f"""{BENEISH},
req AS (SELECT st.*, s_suppkey % 5 <> 0 AS has_sector,
  CASE WHEN s_suppkey % 4 = 1 THEN {OTH} WHEN s_suppkey % 2 = 0 THEN {PUB} ELSE {PRI} END AS model,
  CASE WHEN s_suppkey % 3 = 0 AND (s_suppkey % 4 = 1 OR s_suppkey % 2 = 0) THEN s_acctbal ELSE eq END AS equity
  FROM st LEFT JOIN supplier ON company = s_suppkey),
{_altman_ctes('model', 'equity', 'req')},
e AS (SELECT zz.*, ben.m_score, ben.has_old, {ALTMAN_GAP.replace('company', 'zz.company').replace('period', 'zz.period')} AS ae,
  {BENEISH_GAP.replace('company', 'zz.company').replace('period', 'zz.period')} AS be
  FROM zz JOIN ben ON zz.company = ben.company AND zz.period = ben.period)"""

NO_SECTOR = "Prediksi Risiko Kredit ML gagal: Sektor tidak disediakan, prediksi ML tidak dapat dilakukan."
WITH_MODEL = f"""WITH {TOTALS}, {COMBINED}
SELECT company, period, CASE WHEN be IS NULL THEN m_score END AS m_score,
  CASE WHEN ae IS NOT NULL THEN 'Analisis Altman Z-Score gagal: ' || ae WHEN has_old AND be IS NOT NULL THEN 'Analisis Beneish M-Score gagal: ' || be
       WHEN NOT has_sector THEN '{NO_SECTOR}' END AS error,
  CASE WHEN NOT has_sector THEN split_part('{NO_SECTOR}', ': ', 2) END AS model_error, has_sector AS rated, has_sector AS shares FROM e"""

_SECTORS = list(V.SECTOR_FEATURES)
FEATURES = f"""WITH {TOTALS}, s AS (SELECT *, ebt + intr AS ebit FROM st)
SELECT CAST(now.company AS VARCHAR) || '_' || CAST(now.period AS VARCHAR) AS "UniqueID", CASE WHEN now.cl <> 0 THEN now.ca / now.cl END AS "CurrentRatio",
  CASE WHEN now.eq <> 0 THEN now.tl / now.eq END AS "DebtToEquityRatio", CASE WHEN now.sales <> 0 THEN now.ni / now.sales END AS "NetProfitMargin",
  CASE WHEN now.ta <> 0 THEN now.sales / now.ta END AS "AssetTurnover", CASE WHEN now.intr <> 0 THEN ebit / now.intr END AS "InterestCoverageRatio",
  CASE WHEN old.sales <> 0 THEN now.sales / old.sales END - 1 AS "SalesGrowth", CAST(NULL AS DOUBLE) AS absent,
  coalesce({_SECTORS!r}[CAST(n_regionkey % {len(_SECTORS)} AS INT) + 1], 'Unknown') AS "{V.SECTOR}"
FROM s now LEFT JOIN st old ON old.company = now.company AND old.period = now.period - 1
LEFT JOIN supplier ON s_suppkey = now.company LEFT JOIN nation ON n_nationkey = s_nationkey"""

ORACLES = {
    "altman_public": _altman(PUB),
    "altman_private": _altman(PRI),
    "altman_other": _altman(OTH),
    "altman_mve": _altman(MVE_MODEL, MVE_EQUITY),
    "zone_counts": f"WITH {TOTALS}, {_altman_ctes(PUB)} SELECT period, zone, count(*) AS companies FROM zz GROUP BY period, zone",
    "beneish_scores": f"""WITH {TOTALS}, {BENEISH}
SELECT company, period, m_score, dsri, gmi, aqi, sgi, depi, sgai, lvgi, tata,
  CASE WHEN NOT has_old THEN 'Data periode t-1 tidak tersedia untuk Beneish M-Score.'
       WHEN m_score > -1.78e0 THEN 'Kemungkinan besar perusahaan adalah manipulator (manipulator threshold).'
       WHEN m_score > -2.22e0 THEN 'Zona abu-abu, perlu investigasi lebih lanjut.'
       ELSE 'Kemungkinan kecil perusahaan adalah manipulator.' END AS interpretation FROM ben""",
    "ratio_table": f"""WITH {TOTALS} SELECT company, period,
  CASE WHEN eq = 0 THEN CASE WHEN tl > 0 THEN NULL ELSE 0e0 END ELSE tl / eq END AS debt_to_equity,
  CASE WHEN eq = 0 AND tl > 0 THEN 'inf' ELSE 'finite' END AS debt_to_equity_kind,
  CASE WHEN cl = 0 THEN CASE WHEN ca > 0 THEN NULL ELSE 0e0 END ELSE ca / cl END AS current_ratio,
  CASE WHEN cl = 0 AND ca > 0 THEN 'inf' ELSE 'finite' END AS current_ratio_kind,
  CASE WHEN intr = 0 THEN CASE WHEN ebt + intr = 0 THEN 0e0 END ELSE (ebt + intr) / intr END AS interest_coverage,
  CASE WHEN intr = 0 AND ebt > 0 THEN 'inf' WHEN intr = 0 AND ebt < 0 THEN '-inf' ELSE 'finite' END AS interest_coverage_kind,
  CASE WHEN sales = 0 THEN 0e0 ELSE ni / sales END AS net_margin, CASE WHEN sales = 0 THEN 0e0 ELSE gp / sales END AS gross_margin,
  tl / ta AS debt_ratio, CASE WHEN eq = 0 THEN 'Total Equity is zero.' END AS debt_to_equity_note,
  CASE WHEN cl = 0 THEN 'Current Liabilities are zero.' END AS current_ratio_note FROM st""",
    "growth_table": f"""WITH {TOTALS} SELECT a.company, a.period, CASE WHEN a.eq <> 0 THEN a.ni / a.eq END AS roe,
  CASE WHEN a.ta <> 0 THEN (a.ebt + a.intr) / a.ta END AS roa_ebit, CASE WHEN b.sales <> 0 THEN a.sales / b.sales - 1 END AS sales_growth
FROM st a LEFT JOIN st b ON a.company = b.company AND a.period = b.period + 1""",
    "missing_items": f"""WITH {TOTALS}, p AS (SELECT a.company, a.period, b.company IS NOT NULL AS has_old
  FROM st a LEFT JOIN st b ON a.company = b.company AND a.period = b.period + 1),
g AS (SELECT *, concat_ws(', ', CASE WHEN period % 7 = 0 THEN 'Jumlah ekuitas' END, CASE WHEN company % 5 = 0 THEN 'Beban bunga' END,
  CASE WHEN company % 9 = 0 THEN 'Pendapatan bersih' END) AS gaps FROM p)
SELECT company, period, {ALTMAN_GAP} AS altman_error, {BENEISH_GAP} AS beneish_error,
  CASE WHEN gaps <> '' THEN 'Missing items in data_t for financial ratios: ' || gaps END AS ratio_error FROM g""",
    "coercion_errors": f"""WITH {TOTALS}, v AS (SELECT company, period, CASE company % 6 WHEN 1 THEN 1000e0 WHEN 2 THEN -1500e0
  WHEN 4 THEN 0.5e0 END AS re, CASE company % 6 WHEN 0 THEN '12d' WHEN 3 THEN '' WHEN 5 THEN '1,000' END AS bad FROM st)
SELECT company, period, 1.2e0 * 0e0 + 1.4e0 * (re / 7) + 3.3e0 * 2e0 + 0.6e0 * 1e0 + 0.999e0 * 1e0 AS z_score,
  'ValueError, data Z-Score tidak dapat dikonversi ke float: could not convert string to float: ''' || bad || '''' AS error FROM v""",
    "combined_scores": f"""WITH {TOTALS}, {COMBINED}
SELECT company, period, CASE WHEN ae IS NULL THEN z_score END AS z_score, CASE WHEN ae IS NULL THEN zone ELSE 'Error' END AS zone,
  model_used, CASE WHEN be IS NULL THEN m_score END AS m_score,
  CASE WHEN period % 7 <> 0 AND company % 5 <> 0 AND company % 9 <> 0 THEN CASE WHEN sales = 0 THEN 0e0 ELSE ni / sales END END AS net_margin,
  CASE WHEN ae IS NOT NULL THEN 'Analisis Altman Z-Score gagal: ' || ae
       WHEN has_old AND be IS NOT NULL THEN 'Analisis Beneish M-Score gagal: ' || be
       WHEN NOT has_sector THEN 'Prediksi Risiko Kredit ML gagal: Sektor tidak disediakan, prediksi ML tidak dapat dilakukan.'
       ELSE 'Prediksi Risiko Kredit ML gagal: Model ML, Preprocessor, atau LabelEncoder tidak dimuat. Prediksi tidak dapat dilakukan.' END AS error
FROM e""",
    "combined_with_model": WITH_MODEL,
    "feature_rows": FEATURES,
    "alias_canonical": f"WITH {ALIAS_ROWS} SELECT company, period, item, value FROM kept",
    "statement_maps": f"""WITH {ALIAS_ROWS} SELECT company, period, count(*) AS item_count,
  max(CASE WHEN item = 'Jumlah aset' THEN value END) AS assets FROM kept GROUP BY company, period""",
    "alias_map": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS item_count,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE) ELSE o_totalprice END AS assets FROM orders""",
    "outlook_lookup": """WITH a AS (SELECT c_custkey, n_nationkey, r_name,
  CASE WHEN c_custkey % 7 IN (0, 1) THEN NULL ELSE r_name END AS main, CASE WHEN c_custkey % 7 IN (2, 3) THEN NULL ELSE n_name END AS sub
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, CASE WHEN main IS NOT NULL AND sub IS NOT NULL THEN CASE WHEN r_name = 'ASIA' THEN 'Tidak Diketahui'
    ELSE ['Rendah', 'Menengah', 'Tinggi', 'Menengah ke Tinggi'][n_nationkey % 4 + 1] END
  WHEN main IS NOT NULL THEN 'Sub-industri tidak disediakan untuk industri utama: ' || main || '.'
  ELSE 'Informasi industri tidak disediakan.' END AS outlook FROM a""",
    "order_distribution": """SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS rows FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'order_year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2""",
    "event_class_report": REPORT,
    "scale_features": " UNION ALL ".join([
        _scale("l_quantity", "l_quantity"), _scale("l_extendedprice", "l_extendedprice"),
        _scale("l_discount", "CASE WHEN l_tax > 0 THEN l_discount END"), _scale("l_tax", "l_tax")]),
    "model_choice": f"""WITH {TOTALS}, {_altman_ctes(f"[{PUB}, {PRI}, {OTH}, 'unknown_model'][CAST(company % 4 AS INT) + 1]")}
SELECT company, period, coalesce(zone, 'Error') AS zone, model_used, zone IS NOT NULL AS accepted FROM zz""",
}
