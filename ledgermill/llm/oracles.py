"""DuckDB SQL for the queries that SQL can express. Hash draws, learned profiles, vocabularies, index searches and HTML trees
have no SQL form; their tests compare with brute-force versions."""

from itertools import permutations

_SHINGLES = """
{name}_words AS (SELECT {key} AS k, {words} AS w FROM {table}),
{name}_shingles AS (
  SELECT DISTINCT k, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') || ' (short)' END AS s
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {name}_words WHERE len(w) > 0))"""

_BYTE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_LETTER_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

_GROUPS = "WITH RECURSIVE " + _SHINGLES.format(name="d", key="doc_id", words=_BYTE_WORDS, table="documents") + """,
sizes AS (SELECT k, count(*) AS n FROM d_shingles GROUP BY k),
common AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM d_shingles a JOIN d_shingles b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS k, doc_id AS r FROM documents UNION SELECT reach.k, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.k = doc_id) AS component_id
FROM documents LEFT JOIN sizes ON sizes.k = doc_id"""

_CONTAINED = "WITH " + _SHINGLES.format(name="d", key="doc_id", words=_LETTER_WORDS, table="documents") + "," + _SHINGLES.format(
    name="i", key="item_id", words=_LETTER_WORDS, table="benchmark") + """,
sizes AS (SELECT k, count(*) AS n FROM i_shingles GROUP BY k),
found AS (SELECT d.k AS doc_id, i.k AS item_id, count(*) AS c FROM d_shingles d JOIN i_shingles i ON d.s = i.s GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, c::BIGINT AS n_found, c / n AS containment FROM found JOIN sizes ON k = item_id WHERE c * 100 >= n * 80"""

_VERDICTS = r"""WITH placed AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (SELECT *, regexp_replace(host, '(?s)^.*@|\.?(:[0-9]*)?\z', '', 'g') AS name FROM placed),
parts AS (SELECT *, CASE WHEN regexp_matches(name, '^(([0-9]+\.){3}[0-9]+\z|\[)') THEN [name] ELSE string_split(name, '.') END AS l FROM named),
keyed AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') THEN 2 ELSE 1 END AS s FROM parts),
sited AS (SELECT *, array_to_string(l[-s:], '.') AS suffix, array_to_string(l[-(s + 1):], '.') AS domain FROM keyed),
hosts AS (SELECT host, domain, suffix, count(doc_id)::DOUBLE AS n,
    sum(CASE WHEN doc_id IS NULL THEN 0 ELSE greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1)) END)::DOUBLE AS b
  FROM sited LEFT JOIN labels ON doc_id = page_id WHERE host <> '' GROUP BY host, domain, suffix),
domains AS (SELECT domain, suffix, sum(b) AS b, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(b) AS b, sum(n) AS n FROM domains GROUP BY ALL),
m_s AS (SELECT suffix, (b + (SELECT (sum(b) + 1) / (sum(n) + 2) FROM suffixes) * 20.0) / (n + 20.0) AS m FROM suffixes),
m_d AS (SELECT domain, suffix, (b + m * 20.0) / (n + 20.0) AS m FROM domains JOIN m_s USING (suffix)),
rates AS (SELECT host, n + 20.0 AS z, (b + m * 20.0) / (n + 20.0) AS r FROM hosts JOIN m_d USING (domain, suffix)),
rules (verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT DISTINCT host, path, verdict, rule_host || rule_path AS rule FROM placed JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT host, path, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule FROM fits GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN r - 2.0 * sqrt(r * (1.0 - r) / (z + 1.0)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM placed LEFT JOIN best USING (host, path) LEFT JOIN rates USING (host)"""

_DIGESTS = r"""WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
escaped AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS et, replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS er,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, er, et)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, er, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(et) + CASE WHEN before IS NULL THEN 7 + length(er) WHEN before = role THEN 6 ELSE 14 + length(er) END)::BIGINT + 7 AS formatted_chars
FROM escaped GROUP BY conv_id"""

_EQUAL_TEXTS = r"""WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY x)"""

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
_AUDIT = r"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
split AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY x) AS later FROM texts),
flags AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x))::INT
         + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(later, false)::INT AS mask
  FROM split LEFT JOIN flags USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM masks GROUP BY ALL),
orders (filter_order) AS (VALUES """ + _ORDERS + r"""),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
applied AS (
  SELECT c.*, s.filter_order, s.step, bit, mask & bit <> 0 AS fails, mask & coalesce(before, 0)::BIGINT <> 0 AS gone FROM counts c, steps s)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
       coalesce(sum(t) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(sum(sum(n) FILTER (fails AND NOT gone)) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM applied GROUP BY part, filter_order, step, bit"""


def _rounds(rounds: int = 10) -> str:
    """Lloyd rounds as a chain of common table expressions: c0, a0, c1, a1, ... with exact floor means."""
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    text = """WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT *, sha256('3:' || vec_id) AS h FROM v ORDER BY h, x LIMIT 8))"""
    for i in range(rounds + 1):
        text += f""",
a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (
  SELECT r, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r)"""
        if i < rounds:
            text += f""",
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
  SELECT k, list({floor} ORDER BY p) AS m FROM (
    SELECT best.k AS k, p, sum(x[p]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(p) GROUP BY ALL) GROUP BY k) USING (k))"""
    return text + f"""
SELECT vec_id, best.k::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON k = best.k"""


ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": _GROUPS,
    "op5_benchmark_decontamination": _CONTAINED,
    "op7_url_filter": _VERDICTS,
    "op8_chat_format": _DIGESTS,
    "op11_centroid_clusters": _rounds(),
    "op12_exact_dedup": _EQUAL_TEXTS,
    "op13_filter_audit": _AUDIT,
}
