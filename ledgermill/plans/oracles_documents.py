"""The document queries once more in DuckDB SQL, written from the definitions and from how the texts are composed."""

from __future__ import annotations

from ledgermill import fixed_values as V

NL = "chr(10)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


AMOUNTS = """WITH r AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
p AS (SELECT *, c // 100 AS w, c % 100 AS f FROM r)
SELECT o_orderkey, CASE k WHEN 0 THEN {first} WHEN 1 THEN CAST(c AS DOUBLE) / 100 WHEN 2 THEN CAST(-w AS DOUBLE)
  WHEN 3 THEN {third} WHEN 4 THEN CAST(c AS DOUBLE) / 100 WHEN 5 THEN CAST(-(w * 10000 + f) AS DOUBLE) / 10000
  ELSE CAST(w AS DOUBLE) END AS amount FROM p"""

UNIT_TEXT = """['(Dinyatakan dalam jutaan Rupiah) ', 'Disajikan dalam ribuan mata uang Rupiah ', 'Dalam miliar Rp ',
  '(dinyatakan dalam triliun Rupiah) ', ''][CAST(doc_id % 5 AS INT) + 1]"""
UNIT_RE = (r"\(?(?:Dinyatakan\s+(?:dalam\s+)?|Dalam\s+|Disajikan\s+dalam\s+)(ribu|juta|miliar|triliun)\s*"
           r"(?:mata\s+uang\s+)?(?:Rupiah|Rp)?\)?")
MULT = "CASE doc_id % 5 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 WHEN 2 THEN 1e9 WHEN 3 THEN 1e12 ELSE 1e0 END"

MONTHS = r"(?:31\s+desember\s+|31\s+maret\s+|30\s+juni\s+|30\s+september\s+)?"
CONTEXT_RE = (
    r"(?:laporan\s*(?:konsolidasi\s*)?(?:posisi\s*)?(?:keuangan\s*)?(?:tahunan\s*)?(?:konsolidasian\s*)?(?:interim\s*)?"
    r"untuk\s+tahun\s+yang\s+berakhir\s+(?:pada\s+tanggal\s+|pada\s+)?(?:31\s+desember\s+)?[12][0-9]{3})"
    r"|(?:periode\s+(?:tiga\s+bulan\s+|enam\s+bulan\s+|sembilan\s+bulan\s+|dua\s+belas\s+bulan\s+)?"
    r"(?:yang\s+berakhir\s+)?(?:pada\s+tanggal\s+|pada\s+)?" + MONTHS + r"[12][0-9]{3})"
    r"|(?:tahun\s+buku\s+[12][0-9]{3})|(?:per\s+(?:tanggal\s+)?" + MONTHS + r"[12][0-9]{3})")
REPORT_YEARS = rf"""
WITH t AS (SELECT doc_id, lower(substr(['Laporan keuangan tahunan untuk tahun yang berakhir pada tanggal 31 Desember ',
    'Periode enam bulan yang berakhir pada 30 Juni ', 'Tahun buku ', 'Neraca per 31 Maret ', 'Jilid '][CAST(doc_id % 5 AS INT) + 1]
    || CAST(doc_id * 7 % 160 + 1950 AS VARCHAR) || ', halaman 12.2031' || {NL} || text, 1, 7000)) AS s FROM documents),
u AS (SELECT doc_id, s, regexp_replace(s, '([^a-z0-9])', '\1\1', 'g') AS s2 FROM t),
y AS (SELECT doc_id, [CAST(right(x, 4) AS INT) for x in regexp_extract_all(s, '{CONTEXT_RE}')] AS a,
    [CAST(x AS INT) for x in regexp_extract_all(s2, '(?:^|[^a-z0-9.,_])([12][0-9]{{3}})(?:[^a-z0-9.,%_]|$)', 1)] AS b,
    [CAST(x AS INT) for x in regexp_extract_all(s, '\b2[0-9]{{3}}\b')] AS f FROM u)
SELECT doc_id, CAST(coalesce(list_max([x for x in list_concat(a, b) if x BETWEEN 2000 AND 2099]),
  list_max([x for x in f if x BETWEEN 2000 AND 2099])) AS VARCHAR) AS report_year FROM y"""


def _annual(assets_t: str, assets_t1: str) -> str:
    rows = [
        ("Pendapatan bersih", "t", "n_chars * 1000 + doc_id + 1000"), ("Pendapatan bersih", "t-1", "n_chars * 900 + doc_id + 1000"),
        ("Laba bruto", "t", "n_chars + 1"), ("Beban usaha", "t", "-(n_chars * 7 + 1000)"), ("Beban usaha", "t-1", "doc_id + 2"),
        ("Jumlah aset lancar", "t", "n_chars * 11 + 5"), ("Jumlah aset lancar", "t-1", "n_chars * 10 + 5"),
        ("Jumlah aset", "t", assets_t), ("Jumlah aset", "t-1", assets_t1)]
    return " UNION ALL ".join(
        f"SELECT doc_id, '{item}' AS item, '{kind}' AS period_kind, CAST({value} AS DOUBLE) * {MULT} AS value FROM documents"
        for item, kind, value in rows)


TWO_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, '{item}' AS item, CAST({a} AS DOUBLE) AS val1, CAST({b} AS DOUBLE) AS val2 FROM documents" for item, a, b in [
        ("Pendapatan bersih", "n_chars * 1000 + doc_id + 1000", "n_chars * 900 + doc_id + 1000"),
        ("Laba bruto", "n_chars + 1", "-(n_chars * 7 + 1000)"), ("Beban usaha", "-(n_chars * 7 + 1000)", "doc_id + 2"),
        ("Jumlah aset lancar", "n_chars * 11 + 5", "n_chars * 10 + 5"), ("Jumlah aset", "n_chars * 20 + 7", "n_chars * 19 + 7")])

SPATIAL = """
WITH nums AS (
  SELECT o_orderkey AS doc_id, 2 AS j, CAST(100 + (o_orderkey % 5) * 150 AS DOUBLE) AS x, CAST((o_orderkey % 4) * 4 + 5 AS DOUBLE) AS mid,
         CAST(o_custkey AS DOUBLE) AS value FROM orders
  UNION ALL SELECT o_orderkey, 3, 180, 5, -CAST('2' || CAST(o_orderkey AS VARCHAR) AS DOUBLE) FROM orders
  UNION ALL SELECT o_orderkey, 6, 70 + (o_orderkey % 5) * 150, 45 + (o_orderkey % 4) * 4, CAST(CAST(o_orderkey AS VARCHAR) || '9' AS DOUBLE) FROM orders
  UNION ALL SELECT o_orderkey, 9, 51, 85 + (o_orderkey % 4) * 4, CAST('7' || CAST(o_custkey AS VARCHAR) AS DOUBLE) FROM orders
  UNION ALL SELECT o_orderkey, 10, 52, 85, CAST('8' || CAST(o_custkey AS VARCHAR) AS DOUBLE) FROM orders),
hits(item, x0, x1, mid) AS (VALUES ('Jumlah aset', 0, 80, 5), ('Laba ditahan', 0, 64, 45), ('Jumlah ekuitas', 0, 50, 85)),
near AS (SELECT n.doc_id, h.item, n.value, n.x - h.x1 AS gap, n.j FROM nums n, hits h
  WHERE n.x - h.x1 > 0 AND n.x - h.x1 < 5 * (h.x1 - h.x0) AND abs(n.mid - h.mid) < 7)
SELECT doc_id, item, value FROM near QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY gap, j) = 1"""

BLOCK_LINES = """
WITH b AS (SELECT user_id AS doc_id, event_id AS seq, event_id * 7919 % 1000 AS x, event_id * 104729 % 3000 AS y, event_type AS text FROM events),
g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, x, seq) > 10 THEN 1 ELSE 0 END AS s FROM b),
l AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY y, x, seq) AS BIGINT) AS line_no FROM g)
SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY y, x, seq) AS line_text FROM l GROUP BY doc_id, line_no"""

WORD_LINES = f"""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw, unnest(range(len(string_split(text, ' ')))) AS p FROM documents),
k AS (SELECT doc_id, p // 400 AS page, p // 80 % 5 AS block, p // 40 % 2 AS par, p // 8 % 5 AS line, p, {_strip('raw')} AS tok
      FROM w WHERE p % 13 <> 0)
SELECT doc_id, page, block, par, line, trim(regexp_replace(string_agg(tok, ' ' ORDER BY p), '\\s+', ' ', 'g')) AS line_text
FROM k WHERE tok <> '' GROUP BY doc_id, page, block, par, line"""

PARENTS = f"""
WITH p AS (SELECT conv_id AS doc_id, turn, {_strip(f"['Catatan Entitas Induk' || {NL}, 'Laporan ', 'PARENT ENTITY only' || {NL}][CAST(turn % 3 AS INT) + 1] || text")} AS t
  FROM conversations),
q AS (SELECT *, contains(lower(substr(t, 1, 200)), 'entitas induk') OR contains(lower(substr(t, 1, 200)), 'parent entity') AS keep FROM p)
SELECT doc_id, coalesce(string_agg(t, {NL} || {NL} ORDER BY turn) FILTER (keep), '') AS text FROM q GROUP BY doc_id"""

FILED_LENGTH = f"""length({UNIT_TEXT}) + length(text) + length(format('{{:,}}{{:,}}{{:,}}{{:,}}{{:,}}{{:,}}{{:,}}{{:,}}{{:,}}',
  n_chars * 1000 + doc_id + 1000, n_chars * 900 + doc_id + 1000, n_chars + 1, n_chars * 7 + 1000, doc_id + 2, n_chars * 11 + 5,
  n_chars * 10 + 5, n_chars * 20 + 7, n_chars * 19 + 7)) + 86"""
ENVELOPE = f"""
WITH d AS (SELECT *, doc_id % 9 AS k FROM documents)
SELECT 'lap.' || CAST(doc_id AS VARCHAR) || '.txt' AS nama_file,
  CASE WHEN k = 6 THEN 'Jenis Pengaju: individu, File Type: txt; Using individual keywords'
       ELSE 'Jenis Pengaju: korporat, File Type: txt; Using corporate keywords' END
  || CASE WHEN k = 5 THEN '; Teks yang diekstrak kosong.' ELSE '' END AS info_parsing,
  CASE WHEN k = 4 THEN 'Error TXT: rusak' END AS error_parsing,
  CASE WHEN k IN (4, 5) THEN 0 ELSE {FILED_LENGTH} END AS text_chars,
  CASE WHEN k IN (4, 5) THEN 1e0 ELSE {MULT} END AS multiplier,
  CAST(CASE WHEN k IN (4, 5) THEN NULL WHEN k = 6 THEN 10 ELSE 24 END AS BIGINT) AS items,
  CAST(CASE WHEN k IN (4, 5) THEN NULL WHEN k = 6 THEN 0 ELSE 5 END AS BIGINT) AS found FROM d"""

DELIMITED = """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'Error CSV: jumlah kolom tidak sama'
  WHEN 1 THEN 'Error CSV: tanda kutip tidak ditutup' ELSE
  CAST(o_orderkey AS VARCHAR) || chr(9) || o_orderstatus || chr(13) || chr(10) || o_orderpriority || ',' || chr(10) || chr(9) || 'nan' || chr(9)
  || 'a,"b"' || chr(10) || CAST(o_custkey AS VARCHAR) || chr(9) || 'x' || chr(9) || 'nan' || chr(9) || 'nan' || chr(10)
  || '1' || chr(9) || '2"x' || chr(9) || '3' || chr(9) || '4' END AS text FROM orders"""

DICTIONARY = r"""WITH w AS (SELECT item_id, [x for x in string_split_regex(text, '\s+') if x <> ''] AS w FROM benchmark),
n AS (SELECT *, unnest(range(0, greatest(len(w), 5) // 5)) AS n FROM w),
p AS (SELECT DISTINCT item_id, lower(array_to_string(w[5 * n + 1:5 * n + 1 + n % 5], ' ')) AS phrase FROM n),
d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS form FROM documents)
SELECT doc_id, 'butir ' || CAST(item_id AS VARCHAR) AS item, phrase, instr(form, phrase) AS position FROM d JOIN p ON contains(form, phrase)
WHERE phrase <> ''"""

FILE_NAMES = f"""WITH n AS (SELECT page_id, url, regexp_extract(url || '.PDF', '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, CASE WHEN starts_with(name, '.') THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') END AS stem,
  CASE WHEN starts_with(name, '.') THEN '' ELSE 'pdf' END AS extension,
  replace({_strip("regexp_replace(url, '[^a-zA-Z0-9_ -]', '', 'g')")}, ' ', '_') AS slug FROM n"""

WORD_TOKENS = r"""WITH w AS (SELECT doc_id, [x for x in string_split_regex(lower(text), '[^\p{L}\p{N}_]+')
  if regexp_full_match(x, '[\p{L}\p{N}]+') AND x NOT IN ('the', 'and', 'de', 'la')] AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS tokens, CAST(len(list_distinct(l)) AS BIGINT) AS distinct_tokens FROM w"""

REPLY = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderkey AS DOUBLE) END AS t, CAST(NULL AS DOUBLE) AS t_minus_1,
  CASE WHEN o_orderkey % 4 = 3 THEN 'Gagal mem-parse JSON dari output LLM.' END AS error, o_orderkey % 4 = 3 AS kept_raw FROM orders"""

ANALYST = f"""
a AS (SELECT conv_id * 8 + turn AS applicant_id, CAST((conv_id * 8 + turn) % 6 AS INT) AS i, replace(text, {NL}, ' ') AS flat FROM conversations),
b AS (SELECT *, ['RINGKASAN: Kinerja stabil **[3]** sepanjang tahun' || {NL}, 'RINGKASAN:' || {NL} || 'Baris pertama' || {NL} || 'Baris kedua' || {NL},
    'Berikut adalah analisis: ', 'RINGKASAN: ' || {NL}, '', 'RINGKASAN:' || {NL} || {NL}][i + 1] AS head,
  ['SENTIMEN: Positif', 'SENTIMEN: agak negatif', 'sentimen: Netral', 'SENTIMEN: campuran', 'laba naik dan tumbuh', 'kerugian'][i + 1]
  || {NL} || ['ISU UTAMA:' || {NL} || '1. Utang tinggi' || {NL} || '2. Arus kas lemah' || {NL} || '3. Pasar turun' || {NL} || '4. Sengketa',
    'ISU UTAMA: Likuiditas ketat' || {NL} || '- Denda pajak',
    'ISU UTAMA:' || {NL} || 'Tekanan harga bahan baku' || {NL} || 'pendek' || {NL} || 'KESIMPULAN: selesai' || {NL} || '1. tidak ikut',
    'Ada risiko kurs yang besar', 'tanpa pokok', 'ISU UTAMA: 1. awal' || {NL} || '2. Izin tambang'][i + 1] || {NL} || flat AS body FROM a),
t AS (SELECT *, head || body AS text FROM b),
c AS (SELECT *, CAST(len([x for x in {V.POSITIVE_WORDS!r} if contains(lower(text), x)]) AS BIGINT) AS positive,
  CAST(len([x for x in {V.NEGATIVE_WORDS!r} if contains(lower(text), x)]) AS BIGINT) AS negative FROM t)"""
MOOD = """CASE i WHEN 0 THEN 'Positif' WHEN 1 THEN 'Negatif' WHEN 2 THEN 'Netral' ELSE
  CASE WHEN positive > negative THEN 'Positif' WHEN negative > positive THEN 'Negatif' ELSE 'Netral' END END"""
ISSUES = f"""WITH {ANALYST}, f AS (SELECT *, {_strip('flat')} AS fs FROM c),
g AS (SELECT *, CASE WHEN length(fs) > 10 THEN ' | ' || fs ELSE '' END AS plain,
  CASE WHEN length(fs) > 10 AND length(fs) < 200 AND len([x for x in {V.ISSUE_WORDS!r} if contains(lower(fs), x)]) > 0 THEN fs END AS risky FROM f)
SELECT applicant_id, CASE i WHEN 0 THEN 'Utang tinggi | Arus kas lemah | Pasar turun' WHEN 1 THEN 'Likuiditas ketat | Denda pajak' || plain
  WHEN 2 THEN 'Tekanan harga bahan baku' WHEN 3 THEN concat_ws(' | ', 'Ada risiko kurs yang besar', risky)
  WHEN 4 THEN coalesce(risky, 'Informasi isu belum tersedia dari analisis AI') ELSE 'Izin tambang' || plain END AS issues FROM g"""
SUMMARIES = f"""WITH {ANALYST},
s AS (SELECT *, [{_strip('x')} for x in string_split_regex(CASE WHEN i = 2 THEN body ELSE text END, '[.!?]+')] AS parts FROM c),
k AS (SELECT *, [x for x in parts if length(x) > 20 AND NOT starts_with(lower(x), 'tentu') AND NOT starts_with(lower(x), 'saya akan')
  AND NOT starts_with(lower(x), 'berikut') AND NOT starts_with(lower(x), 'berdasarkan')] AS good FROM s)
SELECT applicant_id, CASE i WHEN 0 THEN 'Kinerja stabil  sepanjang tahun' WHEN 1 THEN 'Baris pertama Baris kedua'
  ELSE array_to_string(good[1:3], '. ') || '.' END AS summary FROM k"""

ITEMS = ", ".join(f"('{n}')" for n, _ in V.CORPORATE_PHRASES)
EXTRACTED = """
ext AS (
  SELECT o_orderkey AS k, 'Pendapatan bersih' AS item, o_totalprice AS t FROM orders
  UNION ALL SELECT o_orderkey, 'Jumlah aset', CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END FROM orders
  UNION ALL SELECT o_orderkey, 'Jumlah ekuitas', CAST(o_orderkey % 10 AS DOUBLE) FROM orders WHERE o_orderkey % 4 <> 1),
tru AS (
  SELECT o_orderkey AS k, 'Pendapatan bersih' AS item, CASE WHEN o_orderkey % 5 = 0 THEN 1000e0 ELSE o_totalprice END AS value
    FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, 'Jumlah aset', CAST(o_custkey AS DOUBLE) FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT o_orderkey, 'Jumlah ekuitas', CAST(o_orderkey % 2 AS DOUBLE) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 <> 2)"""
COUNTS = f"""{EXTRACTED},
docs AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 50 NOT IN (7, 8)),
j AS (SELECT coalesce(e.item, r.item) AS item, e.t, r.value, r.k IS NOT NULL AS wanted
  FROM (SELECT * FROM ext SEMI JOIN docs USING (k)) e FULL JOIN (SELECT * FROM tru SEMI JOIN docs USING (k)) r ON e.k = r.k AND e.item = r.item),
n AS (SELECT names.item, count(*) FILTER (wanted AND t IS NOT NULL) AS tp, count(*) FILTER (NOT wanted AND t IS NOT NULL) AS fp,
  count(*) FILTER (wanted AND t IS NULL) AS fn, count(*) FILTER (wanted) AS gt_occurrences,
  count(*) FILTER (wanted AND t = value) AS exact_value_matches, count(*) FILTER (wanted AND t IS NOT NULL) AS numeric_pairs,
  sum(abs(t - value)) FILTER (wanted) AS es,
  sum(CASE WHEN value <> 0 THEN abs((t - value) / value) * 100 WHEN t <> 0 THEN 100e0 ELSE 0e0 END) FILTER (wanted AND t IS NOT NULL) AS ss
  FROM (VALUES {ITEMS}) names(item) LEFT JOIN j ON names.item = j.item GROUP BY names.item)"""
METRICS = f"""WITH {COUNTS},
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END AS q FROM n)
SELECT item, tp, fp, fn, gt_occurrences, exact_value_matches, numeric_pairs, round(p * 100, 4) AS precision, round(q * 100, 4) AS recall,
  round(CASE WHEN p + q = 0 THEN 0e0 ELSE 2 * (p * q) / (p + q) END * 100, 4) AS f1_score,
  CASE WHEN gt_occurrences > 0 THEN round(tp / gt_occurrences * 100, 4) END AS detection_rate,
  CASE WHEN gt_occurrences > 0 THEN round(exact_value_matches / gt_occurrences * 100, 4) END AS exact_match_rate,
  CASE WHEN numeric_pairs > 0 THEN round(es / numeric_pairs, 4) END AS mean_absolute_error,
  CASE WHEN numeric_pairs > 0 THEN round(ss / numeric_pairs, 4) END AS mean_percentage_error FROM r"""
DETECTION = f"""WITH {EXTRACTED},
s AS (SELECT CASE WHEN e.t IS NOT NULL THEN 0.75e0 ELSE 0.25e0 END AS score, r.k IS NOT NULL AS hit
  FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') d CROSS JOIN (VALUES {ITEMS}) names(item)
  LEFT JOIN ext e ON d.k = e.k AND names.item = e.item LEFT JOIN tru r ON d.k = r.k AND names.item = r.item),
c AS (SELECT score, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS n FROM s GROUP BY score)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, CAST(sum(n * (2 * before + p)) AS DOUBLE)
  / (2e0 * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc
FROM (SELECT *, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)"""

QUALITY = """
q AS (SELECT (n_chars % 997) / 1000e0 AS score, quality AS hit FROM labels JOIN documents USING (doc_id)),
c AS (SELECT score, sum(hit) AS p, sum(1 - hit) AS n FROM q GROUP BY score),
w AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM c)"""

# Counts per (class, label, score), then curves per key as in the definitions.
PROBS = "+ CASE WHEN event_type = '{k}' THEN 20 ELSE 0 END) / 200e0"
SCORES = " UNION ALL ".join(
    f"SELECT event_id, event_type AS label, '{k}' AS class, ((event_id * {31 + 14 * i} + {17 * i}) % 101 {PROBS.format(k=k)} AS score FROM events"
    for i, k in enumerate(["click", "error", "purchase", "signup", "view"]))
MULTICLASS = f"""
WITH s AS ({SCORES}),
k AS (
  SELECT 'class' AS kind, class AS a, '' AS b, score, label = class AS hit FROM s
  UNION ALL SELECT 'micro', '', '', score, label = class FROM s
  UNION ALL SELECT 'ovo', class, label, score, FALSE FROM s WHERE label <> class
  UNION ALL SELECT 'ovo', class, o.c, score, TRUE FROM s CROSS JOIN (SELECT DISTINCT class AS c FROM s) o WHERE label = class AND o.c <> class),
c AS (SELECT kind, a, b, score, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS n FROM k GROUP BY ALL),
w AS (SELECT *, sum(p) OVER (PARTITION BY kind, a, b ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY kind, a, b ORDER BY score DESC) AS cn,
  sum(p) OVER (PARTITION BY kind, a, b) AS tp, sum(n) OVER (PARTITION BY kind, a, b) AS tn,
  lead(p) OVER (PARTITION BY kind, a, b ORDER BY score DESC) AS np, lead(n) OVER (PARTITION BY kind, a, b ORDER BY score DESC) AS nn,
  row_number() OVER (PARTITION BY kind, a, b ORDER BY score DESC) AS pos FROM c),
area AS (SELECT kind, a, b, CAST(sum(n * (2 * (cp - p) + p)) AS DOUBLE) / (2e0 * CAST(any_value(tp) AS DOUBLE) * CAST(any_value(tn) AS DOUBLE)) AS auc,
  any_value(tp) AS tp, any_value(tn) AS tn FROM w GROUP BY kind, a, b),
pool AS (SELECT kind, least(a, b) AS a, greatest(a, b) AS b, avg(auc) AS auc, max(tp + tn) AS rows FROM area WHERE kind = 'ovo' GROUP BY ALL),
pts AS (SELECT a AS class, CAST(cn AS DOUBLE) / CAST(tn AS DOUBLE) AS fpr, CAST(cp AS DOUBLE) / CAST(tp AS DOUBLE) AS tpr FROM w
  WHERE kind = 'class' AND (pos = 1 OR np IS NULL OR np <> p OR nn <> n)
  UNION ALL SELECT DISTINCT class, 0e0, 0e0 FROM s),
kn AS (SELECT class, fpr, min(tpr) AS lo, max(tpr) AS hi FROM pts GROUP BY class, fpr),
grid AS (SELECT g.fpr, o.class, kn.lo, kn.hi FROM (SELECT DISTINCT fpr FROM kn) g CROSS JOIN (SELECT DISTINCT class FROM kn) o
  LEFT JOIN kn ON kn.fpr = g.fpr AND kn.class = o.class),
br AS (SELECT *, last_value(CASE WHEN hi IS NOT NULL THEN fpr END IGNORE NULLS) OVER lw AS lf, last_value(hi IGNORE NULLS) OVER lw AS lt,
  first_value(CASE WHEN hi IS NOT NULL THEN fpr END IGNORE NULLS) OVER rw AS rf, first_value(lo IGNORE NULLS) OVER rw AS rt FROM grid
  WINDOW lw AS (PARTITION BY class ORDER BY fpr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rw AS (PARTITION BY class ORDER BY fpr ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
mean AS (SELECT fpr, avg(coalesce(hi, (rt - lt) / (rf - lf) * (fpr - lf) + lt)) AS tpr FROM br GROUP BY fpr),
trap AS (SELECT (fpr - lag(fpr) OVER (ORDER BY fpr)) * (tpr + lag(tpr) OVER (ORDER BY fpr)) / 2 AS part FROM mean)
SELECT 'class' AS measure, a AS class, round(auc, 9) AS auc FROM area WHERE kind = 'class'
UNION ALL SELECT 'micro', NULL, round(auc, 9) FROM area WHERE kind = 'micro'
UNION ALL SELECT 'macro', NULL, round(sum(part), 9) FROM trap
UNION ALL SELECT 'ovr_macro', NULL, round(avg(auc), 9) FROM area WHERE kind = 'class'
UNION ALL SELECT 'ovr_weighted', NULL, round(sum(auc * tp) / sum(tp), 9) FROM area WHERE kind = 'class'
UNION ALL SELECT 'ovo_macro', NULL, round(avg(auc), 9) FROM pool
UNION ALL SELECT 'ovo_weighted', NULL, round(sum(auc * rows) / sum(rows), 9) FROM pool"""

DOCUMENT_ITEMS = f"""
WITH d AS (SELECT *, doc_id % 4 = 1 AS replied, CASE WHEN doc_id % 4 = 1 THEN 1e0 WHEN doc_id % 9 IN (4, 5) THEN 1e0 ELSE {MULT} END AS m FROM documents),
v AS ({_annual("n_chars * 11 + 5", "n_chars * 10 + 5")}),
p AS (SELECT doc_id, item, max(value) FILTER (period_kind = 't') AS t, max(value) FILTER (period_kind = 't-1') AS t_minus_1 FROM v GROUP BY ALL)
SELECT 'lap.' || CAST(d.doc_id AS VARCHAR) || '.txt' AS nama_file, CASE WHEN d.doc_id % 9 = 4 THEN 'Error TXT: rusak' END AS error_parsing,
  CASE WHEN NOT replied AND d.doc_id % 9 = 4 THEN 'Error TXT: rusak' WHEN NOT replied AND d.doc_id % 9 = 5
       THEN 'Tidak ada data terstruktur yang dapat dihasilkan.' END AS error,
  m AS multiplier, CASE WHEN replied THEN '{V.EQUITY}' ELSE p.item END AS item, CASE WHEN replied THEN CAST(d.doc_id * 3 AS DOUBLE) ELSE p.t END AS t, p.t_minus_1
FROM d LEFT JOIN p ON p.doc_id = d.doc_id AND NOT replied AND d.doc_id % 9 NOT IN (4, 5)"""

DOCUMENT_VIEWS = f"""WITH d AS (SELECT *, {UNIT_TEXT} || chr(10) || 'Pendapatan Bersih ' || format('{{:,}}', n_chars * 1000 + doc_id + 1000) || ' '
  || format('{{:,}}', n_chars * 900 + doc_id + 1000) || chr(10) || 'Laba Kotor ' || format('{{:,}}', n_chars + 1) || chr(10) || 'Beban Usaha ('
  || format('{{:,}}', n_chars * 7 + 1000) || ') ' || format('{{:,}}', doc_id + 2) || chr(10) || 'Jumlah Aset Lancar: ' || format('{{:,}}', n_chars * 11 + 5)
  || ' ' || format('{{:,}}', n_chars * 10 + 5) || chr(10) || 'Total   aset ' || format('{{:,}}', n_chars * 20 + 7) || ' '
  || format('{{:,}}', n_chars * 19 + 7) || chr(10) || text AS filed FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS nama_file, md5(filed) AS text_md5, 'Jenis Pengaju: korporat, File Type: txt; Using corporate keywords' AS info_parsing,
  {MULT} AS multiplier, CAST(n_chars * 1000 + doc_id + 1000 AS DOUBLE) * {MULT} AS sales FROM d"""

REPLY_RECORDS = """WITH k AS (SELECT conv_id * 8 + turn AS k, (conv_id * 8 + turn) % 4 AS s FROM conversations)
SELECT 'PT ' || CAST(k AS VARCHAR) AS "applicantName", CASE s WHEN 2 THEN 'tanpa daftar' WHEN 3 THEN 'Gagal menghasilkan analisis AI.'
    ELSE 'Ringkas ' || CAST(k AS VARCHAR) END AS "groundedSummary",
  CASE s WHEN 2 THEN 'Netral' WHEN 3 THEN 'Error' ELSE 'Positif' END AS "overallSentiment", CASE WHEN s < 2 THEN 'utang|kurs, // harga' ELSE '' END AS issues,
  CASE WHEN s < 2 THEN 'T' || CAST(k AS VARCHAR) || ' http://a//b' ELSE '' END AS sources,
  CASE s WHEN 1 THEN '""" + V.UNKNOWN_OUTLOOK + """' WHEN 3 THEN 'Informasi industri tidak disediakan.' ELSE 'Tinggi' END AS "industrySectorOutlook" FROM k"""

ORACLES = {
    "document_items": DOCUMENT_ITEMS,
    "document_views": DOCUMENT_VIEWS,
    "reply_risk_records": REPLY_RECORDS,
    "amount_module": AMOUNTS.format(first="CAST(c AS DOUBLE) / 100", third="CAST(w * 10 + f // 10 AS DOUBLE) / 10"),
    "amount_service": AMOUNTS.format(first="CASE WHEN w < 1000 THEN CAST(c AS DOUBLE) ELSE CAST(c AS DOUBLE) / 100 END",
                                     third="CAST(w * 10 + f // 10 AS DOUBLE)"),
    "numeric_guard": """SELECT doc_id, count(*) FILTER (regexp_matches(tok, '[0-9]') AND NOT regexp_matches(tok, '[a-zA-Z]{3,}')) AS numeric_tokens
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS tok FROM documents) GROUP BY doc_id""",
    "unit_multipliers": f"""SELECT doc_id, CASE lower(regexp_extract(substr({UNIT_TEXT} || text, 1, 1000), '{UNIT_RE}', 1, 'i'))
  WHEN 'ribu' THEN 1e3 WHEN 'juta' THEN 1e6 WHEN 'miliar' THEN 1e9 WHEN 'triliun' THEN 1e12 ELSE 1e0 END AS multiplier FROM documents""",
    "report_years": REPORT_YEARS,
    "annual_extract": _annual("n_chars * 11 + 5", "n_chars * 10 + 5"),
    "annual_extract_longest": _annual("n_chars * 20 + 7", "n_chars * 19 + 7"),
    "dictionary_extract": _annual("n_chars * 11 + 5", "n_chars * 10 + 5"),
    "dictionary_matches": DICTIONARY,
    "two_value_extract": TWO_VALUES,
    "split_phrase_extract": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderkey + 1000 AS DOUBLE) END AS t,
  CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_custkey AS DOUBLE) END AS t_minus_1 FROM orders""",
    "spatial_amounts": SPATIAL,
    "block_lines": BLOCK_LINES,
    "word_lines": WORD_LINES,
    "parent_documents": PARENTS,
    "document_envelope": ENVELOPE,
    "period_files": """SELECT CAST(doc_id AS VARCHAR) AS nama_file, 't' AS period_kind, CAST(5 AS BIGINT) AS items FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 't-1', CAST(4 AS BIGINT) FROM documents""",
    "delimited_rows": DELIMITED,
    "file_names": FILE_NAMES,
    "word_tokens": WORD_TOKENS,
    "display_times": "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%d %B %Y, %H:%M') || ' WIB' AS shown FROM events",
    "reply_items": REPLY,
    "sentiments": f"WITH {ANALYST} SELECT applicant_id, {MOOD} AS sentiment, positive, negative FROM c",
    "issues": ISSUES,
    "summaries": SUMMARIES,
    "citations": f"""WITH {ANALYST} SELECT applicant_id, CASE WHEN applicant_id % 4 = 0 THEN text ELSE
  substr(text, 1, 3) || ' **[1]**' || substr(text, 4, 2) || ' **[2]**' || substr(text, 6) END AS cited FROM c""",
    "risk_records": f"""WITH {ANALYST} SELECT 'PT. Contoh ' || CAST(applicant_id AS VARCHAR) AS "applicantName", {MOOD} AS "overallSentiment",
  'Informasi industri tidak disediakan.' AS "industrySectorOutlook", CAST(CASE WHEN applicant_id % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS sources,
  CASE WHEN applicant_id % 4 <> 0 THEN 'Source 2' END AS second_title FROM c""",
    "eval_metrics": METRICS,
    "eval_overall": f"""WITH {COUNTS} SELECT CAST(sum(gt_occurrences) AS BIGINT) AS truth_items, CAST(sum(exact_value_matches) AS BIGINT) AS exact_matches,
  CAST(sum(exact_value_matches) AS DOUBLE) / CAST(sum(gt_occurrences) AS DOUBLE) * 100 AS accuracy_percentage FROM n""",
    "eval_coverage": f"WITH {EXTRACTED} SELECT item, count(*) AS documents_found, (SELECT count(*) FROM orders) AS documents FROM ext WHERE t IS NOT NULL GROUP BY item",
    "detection_auc": DETECTION,
    "roc_curve": f"""WITH {QUALITY} SELECT score, CAST(cn AS DOUBLE) / CAST(tn AS DOUBLE) AS fpr, CAST(cp AS DOUBLE) / CAST(tp AS DOUBLE) AS tpr FROM w
UNION ALL SELECT NULL, 0e0, 0e0""",
    "roc_area": f"""WITH {QUALITY} SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
  CAST(sum(n * (2 * (cp - p) + p)) AS DOUBLE) / (2e0 * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc FROM w""",
    "multiclass_areas": MULTICLASS,
    "new_files": """SELECT page_id, url AS path, sha256(url || '|' || CAST(length(html) AS VARCHAR) || '|method:page') AS key FROM pages
WHERE regexp_matches(url, '/(?:de|fr)/')""",
    "purged_results": """SELECT event_type, count(*) AS kept, min(event_id) AS first_event FROM events
WHERE epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(ts) <= 2160000000000 GROUP BY event_type""",
}
