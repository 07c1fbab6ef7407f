"""The same results in DuckDB SQL, from scratch: counts by regular expressions, quantiles by running sums."""

from __future__ import annotations

from . import decontaminate, url_filter, warc
from . import quality_rules as rules
from .queries import URL_RULES

_WORD = r"[^\x20\x09-\x0D]+"


def quality_sql(docs: str = "documents") -> str:
    """A WITH clause body that ends in ``judged``: the columns of docs plus counts, base_failed and kept."""
    count = lambda cls: f"length(regexp_replace(coalesce(text, ''), '[^{cls}]', '', 'g'))"
    div = lambda sql: sql.replace(" div ", " // ")
    rates = ", ".join(f"CASE WHEN n_words > 0 THEN {div(sql)} ELSE 0 END AS {k}" for k, sql in rules.MEASURES.items())
    cells = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {div(rules.bin_sql(k))} AS bin FROM rated WHERE NOT base_failed" for k in rules.MEASURES)
    spread = f"greatest(q75 - q25, CASE rate WHEN '{rules.LENGTH}' THEN q50 // {1 << (rules.HIGH_BITS - 1)} + 1 ELSE 0 END)"
    picks = ", ".join(f"max(hi) FILTER (WHERE rate = '{k}') AS hi_{k}, max(lo) FILTER (WHERE rate = '{k}') AS lo_{k}" for k in rules.MEASURES)
    within = " AND ".join(f"1000 * ({count} - {rules.ALLOWED}) <= f.hi_{k} * {base}" for k, (count, base) in rules.RATES.items()) + f" AND {rules.LENGTH} BETWEEN f.lo_{rules.LENGTH} AND f.hi_{rules.LENGTH}"
    return rf"""
src AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM {docs}),
spots AS MATERIALIZED (SELECT rid, i, array_to_string(w[i : i + {rules.WINDOW - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i FROM src WHERE len(w) >= {rules.WINDOW})),
hits AS (SELECT rid, i FROM spots QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeats AS (SELECT rid, count(DISTINCT i + o) AS n FROM hits, range({rules.WINDOW}) t(o) GROUP BY rid),
counted AS MATERIALIZED (SELECT src.*, len(w) AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  {count('#*$%&|<>')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, len(ls) AS n_lines, {count('A-Z')} AS n_upper, {count('!')} AS n_shout,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter
  FROM (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM src) src LEFT JOIN repeats USING (rid)),
rated AS MATERIALIZED (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, {rates} FROM counted),
cells AS MATERIALIZED (SELECT lang, source, rate, bin, count(*) AS n FROM ({cells}) GROUP BY ALL),
levels AS (SELECT 0 AS level, lang, source, rate, bin, n FROM cells UNION ALL SELECT 1, lang, NULL, rate, bin, sum(n) FROM cells GROUP BY lang, rate, bin UNION ALL SELECT 2, NULL, NULL, rate, bin, sum(n) FROM cells GROUP BY rate, bin),
runs AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY level, lang, source, rate) AS docs FROM levels),
quart AS (SELECT level, lang, source, rate, docs, min(bin) FILTER (WHERE 100 * seen >= 25 * docs) AS q25, min(bin) FILTER (WHERE 100 * seen >= 50 * docs) AS q50, min(bin) FILTER (WHERE 100 * seen >= 75 * docs) AS q75 FROM runs GROUP BY ALL),
bounds AS (SELECT *, q75 + {rules.REACH} * {spread} AS hi, q25 - {rules.REACH} * {spread} AS lo FROM quart),
fences AS MATERIALIZED (SELECT level, lang, source, max(docs) AS docs, {picks} FROM bounds GROUP BY level, lang, source),
chosen AS MATERIALIZED (SELECT g.lang AS glang, g.source AS gsource, CASE WHEN g.docs >= {rules.MIN_DOCS} THEN g WHEN l.docs >= {rules.MIN_DOCS} THEN l ELSE a END AS f
  FROM (SELECT * FROM fences WHERE level = 0) g LEFT JOIN (SELECT * FROM fences WHERE level = 1) l ON g.lang IS NOT DISTINCT FROM l.lang, (SELECT * FROM fences WHERE level = 2) a),
judged AS MATERIALIZED (SELECT rated.*, coalesce(NOT base_failed AND {within}, false) AS kept FROM rated LEFT JOIN chosen ON lang IS NOT DISTINCT FROM glang AND source IS NOT DISTINCT FROM gsource)"""


def decontamination_sql(docs: str = "documents", given: str = "") -> str:
    """A WITH clause body that ends in ``contaminations``: windows by their words, no prefixes or hashes."""
    tokens = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = decontaminate.WINDOW
    return f"""
dw AS MATERIALIZED (SELECT doc_id, {tokens} AS w FROM {docs}),
bw AS MATERIALIZED (SELECT item_id, {tokens} AS w FROM benchmark),
wins AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {n}) AS size, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
found AS MATERIALIZED (SELECT doc_id, item_id, i, size FROM places JOIN wins USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM found, range({n}) t(o) WHERE o < size GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id),
contaminations AS MATERIALIZED (SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id))"""


def jaccard_sql(docs: str = "documents", n: int = 3, p: int = 90, q: int = 100) -> str:
    """A WITH clause body that ends in ``linked``: every pair with a common n-gram, by the n-grams themselves."""
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
jw AS MATERIALIZED (SELECT doc_id, regexp_extract_all({text}, '{_WORD}') AS w FROM {docs}),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM jw WHERE len(w) > 0)),
card AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
near AS MATERIALIZED (SELECT x, y FROM common JOIN card a ON a.doc_id = x JOIN card b ON b.doc_id = y WHERE {q} * k >= {p} * (a.n + b.n - k)),
reach AS (SELECT doc_id, doc_id AS root FROM jw UNION SELECT y, root FROM reach JOIN near ON x = doc_id),
linked AS MATERIALIZED (SELECT jw.doc_id, coalesce(card.n, 0) AS n_shingles, least_root AS component_id FROM jw LEFT JOIN card USING (doc_id) JOIN (SELECT doc_id, min(root) AS least_root FROM reach GROUP BY doc_id) USING (doc_id))"""


def url_sql(rules: list[tuple[str, str]], pages: str = "pages") -> str:
    """A WITH RECURSIVE clause body that ends in ``verdicts``: combinations by counting every subset of every basket."""
    given = ", ".join(f"('{verdict}', '{rule}', '{host}', '{path}')" for verdict, rule in rules for host, path in [url_filter.split_rule(rule)])
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
given(verdict, rule, rhost, rpath) AS (VALUES {given}),
cut AS MATERIALIZED (SELECT row_number() OVER () AS rid, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {lower}), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {pages}),
baskets AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(host, '[.\-]'), lambda x: x <> ''), lambda x: 'host:' || x)
  || list_transform(list_filter(regexp_split_to_array(translate(path, {lower}), '[/.\-_]'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'path:' || x))) AS t FROM cut),
fits AS (SELECT rid, arg_max(rule, (length(rule), rule)) AS rule, arg_max(verdict, (length(rule), rule)) AS verdict FROM cut, given WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
told AS MATERIALIZED (SELECT baskets.*, rule, verdict FROM baskets LEFT JOIN fits USING (rid)),
counted AS MATERIALIZED (SELECT t, verdict, count(*) AS n FROM told WHERE rule IS NOT NULL GROUP BY ALL),
subsets AS (SELECT t, verdict, n, i, [t[i]] AS s FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM counted) UNION ALL SELECT t, verdict, n, j, list_append(s, t[j]) FROM (SELECT *, unnest(range(i + 1, len(t) + 1)) AS j FROM subsets)),
alone AS MATERIALIZED (SELECT s, sum(n) AS k FROM subsets GROUP BY s),
strong AS MATERIALIZED (SELECT s, verdict, sum(n) AS k, sum(n) / any_value(alone.k) AS conf FROM subsets JOIN alone USING (s) GROUP BY s, verdict
  HAVING sum(n) >= greatest({url_filter.MIN_SUPPORT} * (SELECT sum(n) FROM counted), {url_filter.MIN_COUNT}) AND sum(n) / any_value(alone.k) >= {url_filter.MIN_CONFIDENCE}),
mined AS MATERIALIZED (SELECT * FROM strong a WHERE NOT EXISTS (SELECT 1 FROM strong b WHERE b.verdict = a.verdict AND b.conf >= a.conf AND len(b.s) < len(a.s) AND list_has_all(a.s, b.s))),
matched AS (SELECT rid, arg_max(mined.verdict, (conf, k, len(s), mined.verdict)) AS verdict FROM told JOIN mined ON rule IS NULL AND list_has_all(t, s) GROUP BY rid),
verdicts AS (SELECT page_id, host, path, rule, coalesce(told.verdict, matched.verdict, '{url_filter.ALLOW}') AS verdict FROM told LEFT JOIN matched USING (rid))"""


def warc_sql(pages: str = "pages") -> str:
    """A WITH clause body that ends in ``records``."""
    return f"""
heads AS MATERIALIZED (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM {pages}),
firsts AS (SELECT payload_digest, min(page_id) AS refers_to FROM heads WHERE payload_bytes >= {warc.MIN_BYTES} GROUP BY payload_digest),
records AS (SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> refers_to THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> refers_to THEN refers_to END AS refers_to FROM heads LEFT JOIN firsts USING (payload_digest))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": f"WITH {quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
        "op1_ngram_join": f"WITH RECURSIVE {jaccard_sql()} SELECT * FROM linked",
        "op3_decontaminate": f"WITH {decontamination_sql()} SELECT * FROM contaminations",
        "op5_warc": f"WITH {warc_sql()} SELECT * FROM records",
        "op8_url_filter": f"WITH RECURSIVE {url_sql(URL_RULES)} SELECT * FROM verdicts",
    }
