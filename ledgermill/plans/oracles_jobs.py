"""What the jobs must return, in DuckDB SQL over the given tables."""

from __future__ import annotations

from ledgermill import fixed_values as V
from ledgermill.plans.oracles_documents import ANALYST, MOOD, MULT

YEAR = "year(o_orderdate)"

ARRIVING = f"""WITH v AS (SELECT doc_id, {MULT} AS m, n_chars AS n, doc_id AS d FROM documents)
SELECT 'lap.' || CAST(doc_id AS VARCHAR) || '.txt' AS nama_file, item, CAST(a AS DOUBLE) * m AS t, CAST(b AS DOUBLE) * m AS t_minus_1 FROM (
  SELECT doc_id, m, 'Pendapatan bersih' AS item, n * 1000 + d + 1000 AS a, n * 900 + d + 1000 AS b FROM v
  UNION ALL SELECT doc_id, m, 'Laba bruto', n + 1, NULL FROM v
  UNION ALL SELECT doc_id, m, 'Beban usaha', -(n * 7 + 1000), d + 2 FROM v
  UNION ALL SELECT doc_id, m, 'Jumlah aset lancar', n * 11 + 5, n * 10 + 5 FROM v
  UNION ALL SELECT doc_id, m, 'Jumlah aset', n * {{a}}, n * {{b}} FROM v)"""

UPDATES = f"""SELECT * FROM (
  SELECT 0::BIGINT AS batch, 'updated' AS status, count(*) AS rows, 1::BIGINT AS version, 4::BIGINT AS trees FROM orders WHERE {YEAR} = 1996
  UNION ALL SELECT 1, 'unseen_label', count(*), 1, 4 FROM orders WHERE {YEAR} = 1997
  UNION ALL SELECT 2, 'updated', count(*), 3, 6 FROM orders WHERE {YEAR} = 1998)"""

CONTINUED = f"""
SELECT 'new_year' AS batch, 'updated' AS status, 4::BIGINT AS trees, count(*) AS rows, 0::BIGINT AS differing FROM orders WHERE {YEAR} = 1996
UNION ALL SELECT 'unlabelled', 'unseen_label', 4, count(*), 0 FROM orders WHERE {YEAR} = 1997
UNION ALL SELECT 'one_class', 'single_class', 4, count(*), 0 FROM orders WHERE {YEAR} = 1998 AND o_orderstatus = 'O'
UNION ALL SELECT 'none', 'empty', 4, 0, 0
UNION ALL SELECT 'last_year', 'updated', 6, count(*), 0 FROM orders WHERE {YEAR} = 1998"""

STORED = f"""SELECT count(*) AS rows, 0::BIGINT AS differing, 'High,Low,Medium' AS labels FROM orders
WHERE o_orderstatus IN ('F', 'O') OR {YEAR} <> 1997"""

FILES = """WITH o AS (SELECT *, o_orderkey // 1000 AS file FROM orders),
broken AS (SELECT DISTINCT file, CASE file % 7 WHEN 3 THEN 'unreadable' ELSE 'missing_key' END AS reason FROM o
  WHERE file % 7 IN (3, 5) AND o_orderkey % 1000 < 100),
forms (form) AS (VALUES ('lists'), ('lines'))
"""
RECORDS = FILES + """SELECT form, 'doc_' || CAST(o_custkey AS VARCHAR) || '.pdf' AS nama_file, count(*) AS records, arg_min(o_totalprice, o_orderkey) AS assets,
  CAST(min(o_orderkey) AS DOUBLE) AS profit FROM o ANTI JOIN broken USING (file), forms GROUP BY form, o_custkey"""
REJECTED = FILES + "SELECT form, CAST(file AS BIGINT) AS file, reason FROM broken, forms"

TRUTH = """SELECT CAST(s_suppkey AS BIGINT) AS supplier, s_acctbal AS assets, CAST(2 AS BIGINT) AS items FROM supplier WHERE s_suppkey % 10 NOT IN (4, 7)"""

SECTOR = f"{list(V.SECTOR_FEATURES)!r}[CAST(o_custkey % {len(V.SECTOR_FEATURES)} AS INT) + 1]"
RISK = f"CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Low' ELSE CASE WHEN {YEAR} <> 1997 THEN 'Medium' END END"
LEAN = "CASE o_orderstatus WHEN 'F' THEN 0.4e0 WHEN 'O' THEN 0e0 ELSE 0.2e0 END"
SECTOR_FILES = f"""SELECT o_orderkey AS id, CASE WHEN l <> 2 THEN 'PT "' || CAST(o_orderkey AS VARCHAR) || '", Tbk' END AS "NamaPerusahaan",
  CASE WHEN l < 2 THEN {SECTOR} END AS "{V.SECTOR}", CASE WHEN l <> 2 THEN CAST({YEAR} AS INT) END AS "PeriodeTahun",
  CASE WHEN l < 2 THEN o_totalprice / 1e5 END AS "CurrentRatio",
  CASE WHEN l < 3 AND o_custkey % 9 <> 0 THEN (o_custkey % 50) / 50e0 - ({LEAN}) END AS "ROA", CASE WHEN l < 3 THEN {RISK} END AS "{V.TARGET}"
FROM (SELECT *, o_orderkey % 4 AS l FROM orders)"""

SLICES = f"""SELECT {SECTOR} AS "{V.SECTOR}", CAST({YEAR} AS INT) AS "PeriodeTahun", count(*) AS rows, min(o_orderkey) AS first FROM orders
WHERE o_custkey % {len(V.SECTOR_FEATURES)} < 2 AND {YEAR} >= 1996 GROUP BY ALL"""

SPLIT = """SELECT CASE WHEN CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 7) AS BIGINT) % 100 < 70 THEN 'fitted' ELSE 'held' END AS part,
  count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL"""
PICKS = f"""SELECT {SECTOR} AS "{V.SECTOR}", arg_min(CAST(o_orderkey AS VARCHAR), md5('42:' || CAST(o_orderkey AS VARCHAR))) AS "UniqueID",
  arg_min(o_totalprice / 1e5, md5('42:' || CAST(o_orderkey AS VARCHAR))) AS "CurrentRatio" FROM orders GROUP BY {SECTOR}"""

PERIOD_SETS = """SELECT CAST(doc_id AS VARCHAR) AS nama_file, unnest(['t', 't-1']) AS period_kind, CAST(5 AS BIGINT) AS items FROM documents"""

RISK_RUNS = f"""WITH {ANALYST}
SELECT unnest(['a', 'b']) AS run, 'PT. Contoh ' || CAST(applicant_id AS VARCHAR) AS "applicantName", 'PT_Contoh_' || CAST(applicant_id AS VARCHAR) AS applicant_slug,
  {MOOD} AS "overallSentiment", CASE WHEN applicant_id % 3 < 2 THEN 'Rendah' ELSE '{V.UNKNOWN_OUTLOOK}' END AS "industrySectorOutlook" FROM c"""

ORACLES = {
    "arriving_items": ARRIVING.format(a="11 + 5", b="10 + 5"), "model_updates": UPDATES, "continued_trees": CONTINUED, "stored_model": STORED,
    "extraction_records": RECORDS, "rejected_files": REJECTED, "truth_files": TRUTH, "sector_files": SECTOR_FILES, "sector_slices": SLICES,
    "split_sizes": SPLIT, "sector_picks": PICKS, "period_file_sets": PERIOD_SETS, "risk_record_runs": RISK_RUNS}
