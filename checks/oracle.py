"""DuckDB SQL with the same result as each query.

The SQL is written independently of the engine: shared pieces below are the same views
of the given tables that ``broadsheet.sources.benchtables`` describes.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STRONG = _list([" ai ", " llm", " tech ", " thes ", " avec ", " nicht ", " para "])
WEAK = _list([" with ", " this ", " from ", " und ", " des ", " que "])
CAT1 = _list([" thble ", " pour ", " das "])
CAT2 = _list([" thed ", " sich ", " los "])
CAT3 = _list([" attion ", " dans ", " con "])
EU = _list([" avec ", " dans ", " pour ", " nicht ", " sich ", " para ", " con ", " thes ",
            " erin ", " thou "])
FR, DE = _list([" avec ", " dans "]), _list([" nicht ", " sich "])
ES, IE = _list([" para ", " con "]), _list([" thes "])
EU_SOURCES = "('Sifted','Tech.eu','EURACTIV','EuroNews','AlgorithmWatch','TNW')"
LINKS = "['/th','/re','/on']"
SP = "' \t\n\r' || chr(11) || chr(12)"


def _any(text: str, words: str) -> str:
    return f"len(list_filter({words}, lambda k: contains({text}, k))) > 0"


def _hits(text: str, words: str) -> str:
    return f"len(list_filter({words}, lambda k: contains({text}, k)))"


ALIAS = """CASE source WHEN 'src0' THEN 'Sifted' WHEN 'src1' THEN 'Tech.eu' WHEN 'src2' THEN 'EURACTIV'
 WHEN 'src3' THEN 'AlgorithmWatch' WHEN 'src4' THEN 'TNW' WHEN 'src5' THEN 'EuroNews'
 WHEN 'src6' THEN 'Sifted' ELSE source END"""
TITLE = "substr(split_part(text, chr(10), 1), 1, 80)"

# articles
A = f"""a AS (SELECT doc_id AS seq, {TITLE} AS title,
 'https://doc.example/' || substr(sha256(text), 1, 16) AS url, {ALIAS} AS source, text AS content,
 CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 60) ELSE '' END AS summary,
 CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + (doc_id % 60) * INTERVAL 1 DAY END AS published_date,
 TIMESTAMP '2024-03-01' + doc_id * INTERVAL 1 MINUTE AS created_at
 FROM documents)"""

# keyword labels: k
K = A + f""", k0 AS (SELECT *, ' ' || lower(title) || ' ' || lower(content) || ' ' AS t, ' ' || lower(title) || ' ' AS tt FROM a),
k1 AS (SELECT *, ({_any('t', STRONG)} OR {_hits('t', WEAK)} >= 2) AS gate,
 CASE WHEN {_any('t', FR)} THEN 'France' WHEN {_any('t', DE)} THEN 'Germany' WHEN {_any('t', ES)} THEN 'Spain'
 WHEN {_any('t', IE)} THEN 'Ireland' ELSE '' END AS cty,
 CASE WHEN {_any('t', CAT1)} THEN 'startups' WHEN {_any('t', CAT2)} THEN 'policy'
 WHEN {_any('t', CAT3)} THEN 'research' ELSE 'industry' END AS topic,
 {_hits('tt', EU)} AS th, {_hits('t', EU)} AS ah FROM k0),
k AS (SELECT * EXCLUDE (t, tt, gate, cty, topic, th, ah),
 CASE WHEN gate THEN topic ELSE 'other' END AS category,
 CASE WHEN gate THEN cty ELSE '' END AS country,
 CASE WHEN gate THEN least(least(th * 2.0::double, 4.0::double) + least(greatest(ah - th, 0) * 0.5::double, 3.0::double)
  + CASE WHEN source IN {EU_SOURCES} AND (th > 0 OR greatest(ah - th, 0) > 0) THEN 2.0::double ELSE 0.0::double END
  + CASE WHEN cty <> '' THEN 1.0::double ELSE 0.0::double END, 10.0::double) ELSE 0.0::double END AS eu_relevance,
 CASE WHEN gate THEN 0.6::double ELSE 0.7::double END AS confidence FROM k1)"""


def _quality(rows: str, out: str) -> str:
    """Adds quality_score to rows with content, title, source and the labels."""
    return f"""{out} AS (SELECT *, least(
 CASE WHEN w >= 800 THEN 0.30::double WHEN w >= 400 THEN 0.20::double WHEN w >= 200 THEN 0.10::double ELSE 0.0::double END
 + CASE WHEN eu_relevance >= 7 THEN 0.25::double WHEN eu_relevance >= 5 THEN 0.18::double WHEN eu_relevance >= 3 THEN 0.10::double ELSE 0.0::double END
 + CASE WHEN tw BETWEEN 5 AND 20 THEN 0.15::double WHEN tw BETWEEN 3 AND 25 THEN 0.08::double ELSE 0.0::double END
 + CASE WHEN source IN ('Sifted','Tech.eu','EURACTIV','AlgorithmWatch') THEN 0.15::double WHEN source IN ('EuroNews','TNW') THEN 0.10::double ELSE 0.05::double END
 + (CASE WHEN category <> '' THEN 0.05::double ELSE 0.0::double END + CASE WHEN country <> '' THEN 0.05::double ELSE 0.0::double END
 + CASE WHEN summary <> '' THEN 0.05::double ELSE 0.0::double END), 1.0::double) AS quality_score
 FROM (SELECT *, len(regexp_extract_all(content, '\\S+')) AS w, len(regexp_extract_all(title, '\\S+')) AS tw FROM {rows}))"""


S = K + ", " + _quality("k", "s0") + ", s AS (SELECT * EXCLUDE (w, tw) FROM s0)"

STORE_COLS = """url, title, source, category, nullif(country, '') AS country, quality_score,
 nullif(eu_relevance, 0) AS eu_relevance, nullif(confidence, 0) AS confidence,
 sha256(url || '|' || title) AS content_hash, nullif(content, '') AS content, nullif(summary, '') AS summary"""
# the store with document ids
ST = S + f""", st AS (SELECT seq AS id, {STORE_COLS}, published_date, created_at, created_at AS updated_at FROM s)"""
PUBLISHED = "category <> 'other' AND (eu_relevance >= 3.0 OR eu_relevance IS NULL) AND quality_score >= 0.4::double"

# recorded answers
CATEGORY = "(['startups','policy','research','industry','other'])[((doc_id // 8) % 5) + 1]"
COUNTRY = "(['France','Germany',''])[((doc_id // 40) % 3) + 1]"


def _answer(cat: str, cty: str, rel: str, conf: str) -> str:
    return (f"""'{{"category": "' || {cat} || '", "country": ' || {cty} || ', "eu_relevance": ' || {rel} """
            f"""|| ', "confidence": ' || {conf} || '}}'""")


_Q = f"""'"' || {COUNTRY} || '"'"""
_EU, _CONF = "(doc_id % 11)::varchar", "'0.' || (doc_id % 10)::varchar"
_PLAIN = _answer(CATEGORY, _Q, _EU, _CONF)
ANSWER = f"""CASE doc_id % 8 WHEN 0 THEN {_PLAIN}
 WHEN 1 THEN '```json' || chr(10) || {_PLAIN} || chr(10) || '```'
 WHEN 2 THEN {_answer(f"'  ' || upper({CATEGORY}) || ' '", _Q, _EU, _CONF)}
 WHEN 3 THEN {_answer(CATEGORY, _Q, f"'1' || {_EU}", "'1.5'")}
 WHEN 4 THEN {_answer(CATEGORY, "'42'", "CASE WHEN doc_id % 16 = 4 THEN '" + '"high"' + "' ELSE '" + '"7"' + "' END", "'" + '"0.9"' + "'")}
 WHEN 5 THEN '[' || {_PLAIN} || ']'
 WHEN 6 THEN CASE WHEN doc_id % 16 = 6 THEN {_PLAIN} || ' thanks' ELSE '{{"category": ' END
 ELSE CASE WHEN doc_id % 16 = 7 THEN '   ' ELSE '' END END""".replace("'{{\"category\": ' END", "'{\"category\": ' END")
SUMMARY = f"""CASE doc_id % 8 WHEN 0 THEN '"' || {TITLE} || '. It matters. Read on."'
 WHEN 1 THEN 'Not relevant' WHEN 2 THEN '# ' || {TITLE} WHEN 3 THEN '**' || {TITLE} || '**'
 WHEN 4 THEN '<b>' || {TITLE} || '</b> text' WHEN 5 THEN 'A. B. C. D. E. F. G.'
 WHEN 6 THEN {TITLE} || ' was announced. More follows.' ELSE '   ' END"""
RESP = f"""r AS (SELECT doc_id AS seq, stage, CASE WHEN doc_id % 13 = 0 THEN '' ELSE txt END AS text,
 CASE WHEN doc_id % 13 = 0 THEN 'api_error' ELSE 'ok' END AS status,
 CASE WHEN doc_id % 13 = 0 THEN 'rate limited' ELSE '' END AS error,
 'recorded' AS provider, 'small' AS model, doc_id % 900 + 100 AS latency_ms,
 doc_id % 97 + 200 AS tokens_in, doc_id % 13 + 20 AS tokens_out
 FROM (SELECT doc_id, 'classification' AS stage, {ANSWER} AS txt FROM documents WHERE doc_id % 17 <> 5
 UNION ALL SELECT doc_id, 'summary', {SUMMARY} FROM documents WHERE doc_id % 17 <> 5))"""

FENCE = f"""CASE WHEN starts_with(trim(text, {SP}), '```')
 THEN trim(array_to_string(list_filter(string_split(trim(text, {SP}), chr(10)), lambda l: NOT starts_with(trim(l, {SP}), '```')), chr(10)), {SP})
 ELSE trim(text, {SP}) END"""
# parsed classification answers of rows `rc(seq, text)`: p
PARSE = f"""p0 AS (SELECT *, CASE WHEN json_valid(body) THEN body::json END AS j FROM (SELECT *, {FENCE} AS body FROM rc)),
p1 AS (SELECT *, json_type(j) AS jt, json_type(j, '$.category') AS ct, lower(trim(coalesce(j->>'$.category', ''), {SP})) AS cat FROM p0),
p2 AS (SELECT *, CASE WHEN trim(coalesce(text, ''), {SP}) = '' THEN 'empty_response' WHEN j IS NULL THEN 'json_parse_error'
 WHEN jt <> 'OBJECT' THEN 'response_not_dict' WHEN coalesce(ct, 'VARCHAR') <> 'VARCHAR' THEN 'category_not_string'
 WHEN cat NOT IN ('startups','policy','research','industry','other') THEN 'invalid_category: ' || cat ELSE '' END AS reason FROM p1),
p AS (SELECT *, reason = '' AS valid0,
 CASE WHEN reason = '' THEN cat ELSE '' END AS category0,
 CASE WHEN reason = '' AND json_type(j, '$.country') = 'VARCHAR' THEN trim(j->>'$.country', {SP}) ELSE '' END AS country0,
 CASE WHEN reason = '' THEN greatest(0.0::double, least(10.0::double, coalesce(try_cast(j->>'$.eu_relevance' AS double), 0.0::double))) ELSE 0.0::double END AS eu0,
 CASE WHEN reason = '' THEN greatest(0.0::double, least(1.0::double, coalesce(try_cast(j->>'$.confidence' AS double), 0.0::double))) ELSE 0.0::double END AS conf0
 FROM p2)"""
_DEMOTE = "valid0 AND (category0 = 'other' OR conf0 < 0.5::double OR eu0 < 2)"
# checked outcome of all articles: o(seq, category .. fallback_reason)
OUTCOME = RESP + f""", rc AS (SELECT d.doc_id AS seq, CASE WHEN r.status = 'ok' THEN r.text END AS text, coalesce(r.status, 'unknown') AS st, coalesce(r.error, '') AS er
 FROM documents d LEFT JOIN r ON r.seq = d.doc_id AND r.stage = 'classification'), {PARSE},
o AS (SELECT seq, CASE WHEN {_DEMOTE} THEN 'other' ELSE category0 END AS category, country0 AS country,
 CASE WHEN {_DEMOTE} THEN 0.0::double ELSE eu0 END AS eu_relevance, conf0 AS confidence, st = 'ok' AND valid0 AS valid,
 CASE WHEN st = 'ok' AND NOT valid0 THEN 'parse_error' ELSE st END AS status,
 CASE WHEN st <> 'ok' THEN st || ': ' || er WHEN NOT valid0 THEN reason END AS fallback_reason FROM p)"""


def _summary_parse(text: str, rows: str, out: str) -> str:
    """Parsed summaries of rows: adds stext, svalid, sreason."""
    return f"""{out}0 AS (SELECT *, trim({text}, {SP}) AS sraw FROM {rows}),
{out}1 AS (SELECT *, starts_with(upper(replace(replace(sraw, '_', ''), ' ', '')), 'NOTRELEVANT') AS irr,
 CASE WHEN (starts_with(sraw, '"') AND ends_with(sraw, '"')) OR (starts_with(sraw, '''') AND ends_with(sraw, ''''))
 THEN trim(substr(sraw, 2, greatest(length(sraw) - 2, 0)), {SP}) ELSE sraw END AS sbody FROM {out}0),
{out}2 AS (SELECT *, len(list_filter(string_split_regex(sbody, '[.!?](?:\\s|$)'), lambda x: trim(x, {SP}) <> '')) AS sn FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN coalesce(sraw, '') = '' THEN 'empty_summary' WHEN irr THEN '' WHEN sbody = '' THEN 'empty_summary'
 WHEN regexp_matches(sbody, '(?m)^#{{1,6}}\\s') OR contains(sbody, '**') OR regexp_matches(sbody, '<[a-zA-Z/][^>]*>') THEN 'contains_formatting'
 WHEN sn < 1 THEN 'too_short' WHEN sn > 5 THEN 'too_long' ELSE '' END AS sreason FROM {out}2),
{out} AS (SELECT *, sreason = '' AS svalid, CASE WHEN sreason = '' AND irr THEN 'NOT_RELEVANT' WHEN sreason = '' THEN sbody ELSE '' END AS stext FROM {out}3)"""


# html
_TAGS = r"""regexp_replace(regexp_replace(regexp_replace({0}, '<!--(?s:.*?)-->', ' ', 'g'),
 '(?i)<script\b[^>]*>(?s:.*?)</script\s*>|<style\b[^>]*>(?s:.*?)</style\s*>|<template\b[^>]*>(?s:.*?)</template\s*>', ' ', 'g'), '<[a-zA-Z/!?][^>]*>', ' ', 'g')"""


def _clean(html: str) -> str:
    text = _TAGS.format(html)
    for entity, char in (("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"),
                         ("&quot;", "chr(34)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        text = f"replace({text}, '{entity}', {char})"
    text = rf"regexp_replace({text}, 'https?://\S+\.(jpg|jpeg|png|gif|webp|svg)\S*', '', 'g')"
    return rf"coalesce(trim(regexp_replace({text}, '\s+', ' ', 'g')), '')"


_ARTICLE = r"nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1), '')"
_PAGE_TITLE = _clean(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")
_PAGE_TEXT = _clean(f"coalesce({_ARTICLE}, html)")
_ORIGIN = r"regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)"


def _resolved(href: str) -> str:
    """Links of the given pages are rooted, relative to the page's folder, or absolute."""
    folder = rf"regexp_extract(regexp_extract(url, '^[^?#]*'), '^(.*/)', 1)"
    return f"CASE WHEN starts_with({href}, 'http') THEN {href} WHEN starts_with({href}, '/') THEN {_ORIGIN} || {href} ELSE {folder} || {href} END"


HREFS = """h AS (SELECT page_id, url, hs, unnest(range(len(hs))) AS place FROM
 (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages)),
hr AS (SELECT page_id, url, place, hs[place + 1] AS href FROM h)"""
# distinct matching links per page in page order: lk(page_id, url, place, link)
LK = HREFS + f""", l0 AS (SELECT page_id, url, {_resolved('href')} AS link, min(place) AS first_at FROM hr
 WHERE {_any('lower(href)', LINKS)} GROUP BY ALL),
lk AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY first_at) - 1 AS place, link FROM l0)"""

LABELLED = S + """, lb AS (SELECT s.seq AS doc_id, title, CASE WHEN quality_score >= 0.4::double THEN 'keep' ELSE 'drop' END AS strict,
 CASE WHEN quality_score >= 0.2::double THEN 'keep' ELSE 'drop' END AS lenient,
 CASE WHEN l.quality = 1 THEN 'keep' ELSE 'drop' END AS human FROM s JOIN labels l ON l.doc_id = s.seq)"""

TELEMETRY = """tm AS (SELECT user_id AS run_id, event_id, 'https://doc.example/' || event_id::varchar AS article_url, 'small' AS model,
 CASE WHEN event_id % 3 = 0 THEN 'summary' ELSE 'classification' END AS prompt_version,
 (props->>'$.k')::bigint AS tokens_in, floor(value)::bigint AS tokens_out,
 CASE WHEN event_type = 'error' THEN 'api_error' ELSE 'ok' END AS status, ts AS timestamp FROM events)"""
RUNS = """ev AS (SELECT user_id::varchar AS id, ts AS event_time,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
 'scrape' AS job_type, CASE WHEN event_type = 'purchase' THEN floor(value)::bigint END AS result_count,
 CASE WHEN event_type = 'error' THEN 'event ' || event_id::varchar END AS error_message, event_id FROM events),
rs AS (SELECT id, status, job_type, min(event_time) OVER (PARTITION BY id) AS started_at,
 CASE WHEN status IN ('completed','failed') THEN event_time END AS completed_at, result_count, error_message,
 row_number() OVER (PARTITION BY id ORDER BY event_time DESC, event_id DESC) AS n FROM ev),
states AS (SELECT * EXCLUDE (n) FROM rs WHERE n = 1)"""

# feed items as they are parsed
ITEMS = f"""e AS (SELECT try_cast(regexp_extract(source, '(\\d+)$', 1) AS bigint) AS source_rank,
 'https://feed.example/' || source || '.xml' AS feed_url, source AS feed_title, doc_id AS idx,
 CASE WHEN doc_id % 11 <> 0 THEN trim({TITLE}) ELSE 'No title' END AS title,
 CASE WHEN doc_id % 9 <> 0 THEN 'https://feed.example/' || doc_id::varchar ELSE '' END AS link,
 '<p>' || text || '</p>' AS summary,
 CASE WHEN doc_id % 7 <> 0 THEN strftime(TIMESTAMP '2024-01-01 08:30:00' + (doc_id % 60) * INTERVAL 1 DAY, '%a, %d %b %Y %H:%M:%S') || ' +0200' ELSE '' END AS published,
 CASE WHEN doc_id % 4 = 0 THEN '<div>' || text || '</div>' END AS full_text,
 CASE WHEN doc_id % 5 = 0 THEN 'https://img.example/m' || doc_id::varchar || '.jpg' END AS media_url,
 CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END::bigint AS n_enclosures FROM documents)"""

WITH = "WITH "
LABELS = "category, country, eu_relevance, confidence"

ORACLE["feed_entries"] = WITH + ITEMS + " SELECT * FROM e"
ORACLE["page_scan"] = WITH + LK + f""", pe AS (SELECT page_id, {_PAGE_TITLE} AS page_title, {_PAGE_TEXT} AS page_text FROM pages),
f0 AS (SELECT lk.link AS url, page_title, page_text FROM lk JOIN pe ON pe.page_id = lk.page_id + 1 + lk.place),
f AS (SELECT url, max((page_title, page_text)) AS x FROM f0 GROUP BY url)
SELECT lk.page_id * 10 + lk.place AS seq, f.x[1] AS title, lk.link AS url, lk.url AS source, f.x[2] AS content,
 '' AS summary, NULL::timestamp AS published_date, NULL::varchar AS image_url
FROM lk JOIN f ON f.url = lk.link WHERE lk.place < 10"""
ORACLE["articles_csv"] = WITH + A + """ SELECT seq::varchar AS id, url, title, source, '' AS category, '' AS country, content, summary,
 strftime(created_at, '%Y-%m-%d %H:%M:%S') AS published_date FROM a"""
ORACLE["store_recent"] = WITH + ST + " SELECT id, title, url, source, category, country, eu_relevance, created_at FROM st ORDER BY created_at DESC, id LIMIT 25"
ORACLE["model_responses"] = WITH + RESP + " SELECT * FROM r"
UPSERT = S + f""", b AS (SELECT seq, {STORE_COLS}, published_date, TIMESTAMP '2024-03-01' AS created_at, TIMESTAMP '2024-03-01' AS updated_at FROM s),
old AS (SELECT * FROM b WHERE seq % 5 = 0),
n AS (SELECT * FROM b WHERE seq % 5 <> 0 AND url NOT IN (SELECT url FROM old) AND content_hash NOT IN (SELECT content_hash FROM old)),
ins AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)"""
BATCH = S + """, few AS (SELECT * FROM s WHERE seq % 5 <> 0 AND seq % 9 = 2), others AS (SELECT * FROM s WHERE seq % 5 <> 0 AND seq % 9 = 4),
batch AS (SELECT * FROM s WHERE seq % 5 <> 0
 UNION ALL SELECT * REPLACE (seq + (1::bigint << 40) AS seq, url || '/2|x' AS url) FROM few
 UNION ALL SELECT * REPLACE (seq + (2::bigint << 40) AS seq, url || '/2' AS url, 'x|' || title AS title) FROM few
 UNION ALL SELECT * REPLACE (seq + (3::bigint << 40) AS seq, url || '/2' AS url) FROM few
 UNION ALL SELECT * REPLACE (seq + (4::bigint << 40) AS seq, url || '/3|y' AS url) FROM others),
old AS (SELECT url, sha256(url || '|' || title) AS content_hash FROM (SELECT url, title FROM s WHERE seq % 5 = 0
 UNION ALL SELECT url || '/3', 'y|' || title FROM others))"""
# the sequential walk over what the store doesn't know, one row per step
ORACLE["store_upsert"] = "WITH RECURSIVE " + BATCH + f""", b AS (SELECT seq, {STORE_COLS}, published_date, TIMESTAMP '2024-03-01' AS created_at, TIMESTAMP '2024-03-01' AS updated_at FROM batch),
 o AS (SELECT *, hash(url) AS u, hash(content_hash) AS t, row_number() OVER (ORDER BY seq) AS n FROM b
 WHERE url NOT IN (SELECT url FROM old) AND content_hash NOT IN (SELECT content_hash FROM old)),
 walk AS (SELECT 0::bigint AS n, []::ubigint[] AS us, []::ubigint[] AS ts, false AS kept
 UNION ALL SELECT x.n, CASE WHEN k THEN list_append(us, x.u) ELSE us END, CASE WHEN k THEN list_append(ts, x.t) ELSE ts END, k
 FROM (SELECT w.us, w.ts, NOT list_contains(w.us, o.u) AND NOT list_contains(w.ts, o.t) AS k, o.n, o.u, o.t FROM walk w JOIN o ON o.n = w.n + 1) AS x)
 SELECT o.* EXCLUDE (u, t, n) FROM o JOIN walk USING (n) WHERE kept"""


def _mean(column: str) -> str:
    """Mean of the non-zero values to two decimals, half up, in whole numbers."""
    total = f"sum(round({column} * 1000000)::hugeint)"
    n = f"count(*) FILTER ({column} <> 0)"
    return f"CASE WHEN {n} > 0 THEN (((200 * {total} + {n} * 1000000) // (2 * {n} * 1000000))::bigint)::double / 100 END"


METRICS = f""" SELECT source, count(*) AS articles_fetched, count(*) FILTER (quality_score >= 0.6::double) AS articles_stored,
 count(*) FILTER (eu_relevance >= 3) AS articles_passed_relevance, {_mean('eu_relevance')} AS avg_eu_relevance,
 {_mean('quality_score')} AS avg_quality_score,
 (SELECT '{{' || string_agg('"' || c || '":' || n::varchar, ',' ORDER BY c) || '}}' FROM (SELECT category AS c, count(*) AS n FROM s s2 WHERE s2.source = s.source AND category <> '' GROUP BY 1)) AS category_distribution
 FROM s GROUP BY source"""
ORACLE["source_run_metrics"] = WITH + S + METRICS
ORACLE["source_metrics_append"] = WITH + S + f""" SELECT 'run-1' AS run_id, source AS source_name, * EXCLUDE (source), TIMESTAMP '2024-03-01' AS timestamp FROM ({METRICS})"""
ORACLE["telemetry_append"] = WITH + TELEMETRY + """ SELECT run_id::varchar AS run_id, article_url, model, prompt_version, tokens_in * 3 AS latency_ms, tokens_in, tokens_out,
 status, CASE WHEN status <> 'ok' THEN status || ': ' END AS fallback_reason, timestamp FROM tm"""
CHANGED = "(st.category IS DISTINCT FROM o.category OR st.country IS DISTINCT FROM o.country OR abs(o.eu_relevance - coalesce(st.eu_relevance, 0)) > 0.5)"
RECLASS = ST + ", " + OUTCOME
DIFF = f""" SELECT st.id, substr(st.title, 1, 80) AS title, st.category AS old_category, o.category AS new_category, st.country AS old_country,
 o.country AS new_country, st.eu_relevance AS old_eu_relevance, o.eu_relevance AS new_eu_relevance, o.confidence AS confidence
 FROM st JOIN o ON o.seq = st.id AND o.valid WHERE {CHANGED}"""
ORACLE["reclassify_diff"] = WITH + RECLASS + DIFF
ORACLE["change_log_csv"] = WITH + RECLASS + f" SELECT * REPLACE (coalesce(old_country, '') AS old_country, coalesce(new_country, '') AS new_country) FROM ({DIFF})"
COMPARE = K + ", " + OUTCOME + """, cmp AS (SELECT k.seq, k.url, k.title, k.source, k.content, k.category AS keyword_category, k.country AS keyword_country,
 CASE WHEN o.valid THEN o.category ELSE 'FAIL' END AS model_category, CASE WHEN o.valid THEN o.country ELSE '-' END AS model_country,
 CASE WHEN o.valid THEN o.eu_relevance END AS model_eu_relevance, o.valid AND o.category = k.category AS match FROM k JOIN o ON o.seq = k.seq)"""
ORACLE["compare_labelers"] = WITH + COMPARE + " SELECT * EXCLUDE (url, content) FROM cmp"
ORACLE["eval_set_csv"] = WITH + COMPARE + """ SELECT url, title, source, substr(content, 1, 200) AS content_preview, keyword_category, model_category AS llm_category,
 model_country AS llm_country, coalesce(model_eu_relevance::varchar, '') AS llm_eu_relevance, '' AS human_category, '' AS human_country,
 '' AS human_eu_relevance, '' AS notes FROM cmp"""
SLUG = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(strip_accents(lower(title)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), '([0-9]),([0-9])', '\1\2', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"""


def _spelled(pairs: str) -> str:
    """SLUG of a title in another script: what its letters are spelled as, one after another."""
    text = "lower(title)"
    for pair in pairs.split():
        letter, spelling = pair.split("=")
        text = f"replace({text}, '{letter}', '{spelling}')"
    return SLUG.replace("lower(title)", text)


GREEK_SLUG = _spelled("h=e f=ph q=th w=o y=ps c=kh")
CYRILLIC_SLUG = _spelled("y=1y h=kh c=ts j=i q=iu w=ia x=shch 1y=y")
GREEK_TITLE = "translate(lower(title), 'abgdeziklmnoprstufhxqwyc', 'αβγδεζικλμνοπρστυφηξθωψχ')"
CYRILLIC_TITLE = "translate(lower(title), 'abvgdeziklmnoprstufhcyjqwx', 'абвгдезиклмнопрстуфхцыйюящ')"
DOC_DATE = "strftime(coalesce(published_date, TIMESTAMP '2024-03-01'), '%Y-%m-%d')"
HEADER = f"""'---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'date: "' || {DOC_DATE} || '"' || chr(10) || 'author: "Newsroom"' || chr(10)
 || 'source: "' || source || '"' || chr(10) || 'url: "' || url || '"' || chr(10) || 'pillar: "' || category || '"' || chr(10)
 || CASE WHEN country <> '' THEN 'country: "' || country || '"' || chr(10) ELSE '' END
 || CASE WHEN summary <> '' THEN 'description: "' || substr(summary, 1, 160) || '"' || chr(10) ELSE '' END
 || 'coverImage: "/assets/featured-story.jpg"' || chr(10) || 'isFeatured: false' || chr(10) || 'isAiGenerated: true' || chr(10) || '---'"""
ORACLE["markdown_docs"] = WITH + S + f""", named AS (SELECT * REPLACE (CASE seq % 4 WHEN 1 THEN {GREEK_TITLE} WHEN 2 THEN {CYRILLIC_TITLE} ELSE title END AS title),
 {DOC_DATE} || '-' || CASE seq % 4 WHEN 1 THEN {GREEK_SLUG} WHEN 2 THEN {CYRILLIC_SLUG} ELSE {SLUG} END || '.md' AS filename FROM s)
 SELECT filename, {DOC_DATE} AS doc_date, {HEADER} || chr(10) || chr(10) || content AS body
 FROM named QUALIFY row_number() OVER (PARTITION BY filename ORDER BY seq DESC) = 1"""
ORACLE["front_matter"] = WITH + S + f" SELECT seq, {HEADER} AS header FROM s"
ORACLE["slug"] = WITH + A + f" SELECT seq, {SLUG} AS slug, {GREEK_SLUG} AS greek, {CYRILLIC_SLUG} AS cyrillic FROM a"
ORACLE["run_log"] = WITH + RUNS + " SELECT id, event_time, status, job_type, result_count, error_message, CASE WHEN status IN ('completed','failed') THEN event_time END AS completed_at FROM ev"
ORACLE["schema_align"] = WITH + S + """ SELECT seq, url, source, NULL::double AS confidence, NULL::double AS eu_relevance, NULL::varchar AS image_url FROM a
 UNION ALL SELECT seq, url, source, nullif(confidence, 0), nullif(eu_relevance, 0), NULL FROM s"""

ORACLE["clean_text"] = f"SELECT page_id, {_clean('html')} AS text FROM pages"
ORACLE["article_hash"] = WITH + A + " SELECT seq, sha256(title || url || source) AS article_hash FROM a"
ORACLE["content_hash"] = WITH + A + " SELECT seq, sha256(url || '|' || title) AS content_hash FROM a"
ORACLE["normalize_source"] = f"SELECT doc_id, {ALIAS} AS source FROM documents"
ORACLE["parse_date_formats"] = WITH + A + " SELECT seq, CASE WHEN seq % 8 < 7 THEN created_at END AS published_date FROM a"
ORACLE["valid_image_url"] = r"""SELECT doc_id, CASE WHEN regexp_matches(u, '^https?://') AND length(u) <= 2048 THEN u END AS image_url FROM
 (SELECT doc_id, trim((['https://i.example/',' http://i.example/','ftp://i.example/','//i.example/',''])[(doc_id % 5) + 1] || regexp_replace(text, '\s+', '-', 'g') || ' ') AS u FROM documents)"""
ORACLE["feed_image"] = WITH + ITEMS + """ SELECT idx, CASE WHEN idx % 6 = 0 THEN 'https://img.example/page.webp' WHEN media_url IS NOT NULL THEN media_url
 WHEN idx % 3 = 0 THEN 'https://img.example/e' || idx::varchar || '.png' END AS image_url FROM e"""
ORACLE["feed_text"] = WITH + ITEMS + f" SELECT idx, coalesce(nullif({_clean('full_text')}, ''), nullif({_clean('summary')}, '')) AS text FROM e"
ORACLE["content_fallback"] = WITH + A + """ SELECT seq, CASE WHEN length(p) < 200 AND length(f) > length(p) THEN f ELSE p END AS content FROM
 (SELECT seq, coalesce(CASE WHEN seq % 2 = 0 THEN 'a page in short' WHEN seq % 3 = 0 THEN content END, '') AS p,
 CASE WHEN seq % 5 <> 0 THEN content END AS f FROM a)"""
RELATED = "".join(f'<li><a href="/r/{k}">Another article to read, number {k}</a></li>' for k in range(5))
_HTML = f"""CASE WHEN page_id % 2 = 1 THEN replace(replace(html, '<article>', '<div>'), '</article>', '</div><ul>{RELATED}</ul><p>We use cookies.') ELSE html END"""
_OWN = "html"
for _tag in ("script", "style", "head", "nav", "footer"):
    _OWN = rf"regexp_replace({_OWN}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', ' ', 'g')"
_OWN = f"regexp_replace({_OWN}, '(?s)<!--.*?-->', ' ', 'g')"
# the run of blocks with the largest sum, out of all runs
MAIN = rf"""h AS (SELECT page_id, {_HTML} AS html FROM pages),
 bl AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) AS i FROM
 (SELECT page_id, string_split_regex({_OWN}, '(?i)</?(?:body|div|h1|html|li|p|ul)\b[^>]*>') AS b FROM h)),
 bn AS (SELECT *, length(trim(regexp_replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS n FROM bl),
 bs AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE n - 40 - 3 * coalesce(list_sum(list_transform(regexp_extract_all(block, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1), lambda x: length(regexp_replace(x, '<[^>]*>', '', 'g')))), 0) END AS score FROM bn),
 bp AS (SELECT *, sum(score) OVER (PARTITION BY page_id ORDER BY i) AS upto FROM bs),
 br AS (SELECT f.page_id, f.i AS lo, l.i AS hi FROM bp f JOIN bp l ON l.page_id = f.page_id AND l.i >= f.i
 QUALIFY row_number() OVER (PARTITION BY f.page_id ORDER BY l.upto - f.upto + f.score DESC, l.i, f.i DESC) = 1),
 mt AS (SELECT page_id, string_agg(block, ' ' ORDER BY i) AS main FROM bl JOIN br USING (page_id) WHERE i BETWEEN lo AND hi GROUP BY 1)"""
ORACLE["page_extract"] = f"""WITH {MAIN} SELECT page_id, {_PAGE_TITLE} AS page_title, CASE WHEN page_id % 2 = 1 THEN {_clean('main')} ELSE {_PAGE_TEXT} END AS page_text,
 CASE WHEN page_id % 3 = 0 THEN 'About & page ' || page_id::varchar ELSE '' END AS page_summary,
 CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-01-05 10:00:00' END AS page_published,
 CASE WHEN page_id % 3 = 0 THEN 'https://img.example/' || page_id::varchar || '.png' END AS page_image FROM pages JOIN mt USING (page_id)"""
ORACLE["resolve_urls"] = WITH + HREFS + f" SELECT page_id, place, {_resolved('href')} AS link FROM hr"
ORACLE["render_prompt"] = WITH + A + rf""" SELECT seq, 'Outlet: ' || source || chr(10) || 'Headline: ' || title || chr(10) || '---' || chr(10)
 || substr({_clean('content')}, 1, 1500) || chr(10) || '---' || chr(10) || 'Answer in JSON.' AS prompt FROM a"""
ORACLE["complete_prompts"] = WITH + "p AS (" + ORACLE["render_prompt"] + r""") SELECT seq, 'classification' AS stage,
 CASE WHEN length(prompt) % 5 = 0 THEN '' ELSE length(prompt)::varchar END AS text, CASE WHEN length(prompt) % 5 = 0 THEN 'api_error' ELSE 'ok' END AS status,
 CASE WHEN length(prompt) % 5 = 0 THEN 'no such size' ELSE '' END AS error, CASE WHEN length(prompt) % 5 = 0 THEN '' ELSE 'size' END AS model,
 CASE WHEN length(prompt) % 5 = 0 THEN 0 ELSE len(regexp_extract_all(prompt, '\S+')) END AS tokens_in, 0::bigint AS tokens_out FROM p"""
ORACLE["strip_code_fence"] = WITH + RESP + f" SELECT seq, {FENCE} AS body FROM r WHERE stage = 'classification'"
PARSED = RESP + f", rc AS (SELECT seq, text FROM r WHERE stage = 'classification'), {PARSE}"
ORACLE["parse_classification"] = WITH + PARSED + " SELECT seq, category0 AS category, country0 AS country, eu0 AS eu_relevance, conf0 AS confidence, valid0 AS valid, reason AS fallback_reason FROM p"
ORACLE["validate_classification"] = WITH + PARSED + f""" SELECT seq, CASE WHEN {_DEMOTE} THEN 'other' ELSE category0 END AS category, country0 AS country,
 CASE WHEN {_DEMOTE} THEN 0.0::double ELSE eu0 END AS eu_relevance, conf0 AS confidence, valid0 AS valid FROM p"""
ORACLE["parse_summary"] = WITH + _summary_parse("text", "conversations", "q") + " SELECT conv_id, turn, stext AS text, svalid AS valid, sreason AS fallback_reason FROM q"
ORACLE["word_count"] = r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents"

ORACLE["fresh_articles"] = WITH + A + " SELECT seq, published_date FROM a WHERE published_date IS NULL OR published_date >= TIMESTAMP '2024-03-01' - INTERVAL 30 DAY"
ORACLE["tech_relevant"] = WITH + K + " SELECT k1.seq, k1.url FROM k1 WHERE gate"
ORACLE["quality_gate"] = WITH + S + " SELECT seq, quality_score FROM s WHERE quality_score >= 0.6::double"
ORACLE["published_view"] = WITH + ST + f" SELECT id, category, eu_relevance, quality_score FROM st WHERE {PUBLISHED}"
ORACLE["facet_filter"] = WITH + ST + f" SELECT id, category, country, quality_score FROM st WHERE {PUBLISHED} AND category = 'startups' AND country = 'France' AND quality_score >= 0.5::double"
ORACLE["filtered_total"] = WITH + ST + f" SELECT count(*) AS total FROM st WHERE {PUBLISHED} AND category = 'startups'"
ORACLE["landed_feeds"] = WITH + ITEMS + " SELECT feed_title, title, link, published, media_url, n_enclosures FROM e"
ORACLE["link_keywords"] = WITH + HREFS + f" SELECT page_id, place, href FROM hr WHERE {_any('lower(href)', LINKS)}"
PAGE = "id, title, url, source, category, country, quality_score, summary, created_at, published_date"
ORACLE["articles_by_id"] = WITH + ST + f" SELECT {PAGE} FROM st WHERE id IN (SELECT doc_id FROM labels)"
ORACLE["run_state"] = WITH + RUNS + " SELECT * FROM states"
STUCK = "status = 'running' AND started_at < TIMESTAMP '2024-03-01' - INTERVAL 30 MINUTE"
ORACLE["stuck_runs"] = WITH + RUNS + f" SELECT id, status, started_at FROM states WHERE {STUCK}"
ORACLE["sweep_events"] = WITH + RUNS + f""" SELECT id, TIMESTAMP '2024-03-01' AS event_time, 'failed' AS status, job_type, result_count, 'timeout_cleanup' AS error_message
 FROM states WHERE {STUCK}"""
ORACLE["sweep_stuck_runs"] = WITH + RUNS + f""" SELECT id, CASE WHEN {STUCK} THEN 'failed' ELSE status END AS status,
 CASE WHEN {STUCK} THEN TIMESTAMP '2024-03-01' ELSE completed_at END AS completed_at,
 CASE WHEN {STUCK} THEN 'timeout_cleanup' ELSE error_message END AS error_message FROM states"""
ORACLE["summarizable"] = WITH + A + " SELECT seq FROM a WHERE length(content) >= 200"
ORACLE["labeled_only"] = """SELECT l.doc_id, CASE WHEN quality = 1 THEN ' keep ' ELSE 'drop' END AS human_category
 FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 OR toxic = 1"""
ORACLE["short_content"] = WITH + A + " SELECT seq, length(content) AS chars FROM a WHERE length(content) < 500"

ORACLE["join_source_alias"] = "SELECT doc_id, CASE WHEN right(source, 1) IN ('0','3','6','9') THEN upper(source) ELSE source END AS source FROM documents"
ORACLE["join_source_tier"] = WITH + A + """ SELECT seq, source, CASE WHEN source IN ('Sifted','Tech.eu','EURACTIV','AlgorithmWatch') THEN 1
 WHEN source IN ('EuroNews','TNW') THEN 2 ELSE 3 END::bigint AS tier FROM a"""
ORACLE["semi_eu_source"] = WITH + A + f" SELECT seq, source FROM a WHERE source IN {EU_SOURCES}"
ORACLE["anti_store"] = WITH + A + """, b AS (SELECT seq, url, sha256(url || '|' || title) AS content_hash FROM a)
 SELECT * FROM b WHERE seq % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.seq % 5 = 0 AND (o.url = b.url OR o.content_hash = b.content_hash))"""
ORACLE["join_response"] = WITH + A + ", " + RESP + " SELECT a.seq, a.url, r.status, r.text, r.tokens_in FROM a LEFT JOIN r ON r.seq = a.seq AND r.stage = 'classification'"
ORACLE["outer_source_counts"] = WITH + S + """, f AS (SELECT source, count(*) AS n FROM s WHERE source <> 'Sifted' GROUP BY 1),
 c AS (SELECT source, count(*) AS n FROM s WHERE source <> 'TNW' GROUP BY 1), t AS (SELECT source, count(*) AS n FROM s WHERE quality_score >= 0.6::double GROUP BY 1)
 SELECT source, coalesce(f.n, 0) AS fetched, coalesce(c.n, 0) AS scored, coalesce(t.n, 0) AS stored FROM f FULL JOIN c USING (source) FULL JOIN t USING (source)"""
ORACLE["join_reclassified"] = WITH + RECLASS + " SELECT st.id, st.category, o.category AS new_category, st.country, o.country AS new_country FROM st JOIN o ON o.seq = st.id AND o.valid"
ORACLE["join_labels"] = WITH + LABELLED + " SELECT * FROM lb"
ORACLE["entry_page"] = WITH + ITEMS + f""", g AS (SELECT 'https://feed.example/' || (page_id * 3)::varchar AS url, {_PAGE_TEXT} AS page_text FROM pages)
 SELECT idx, link, page_text FROM e LEFT JOIN g ON g.url = e.link"""

ORACLE["fetched_by_source"] = WITH + A + " SELECT source, count(*) AS articles_fetched FROM a GROUP BY 1"
ORACLE["stored_by_source"] = WITH + UPSERT + " SELECT source, count(*) AS articles_stored FROM ins GROUP BY 1"
ORACLE["passed_relevance"] = WITH + S + " SELECT source, count(*) FILTER (eu_relevance >= 3) AS articles_passed_relevance FROM s GROUP BY 1"
ORACLE["avg_relevance"] = WITH + S + f" SELECT source, {_mean('eu_relevance')} AS avg_eu_relevance FROM s GROUP BY 1"
ORACLE["avg_quality"] = WITH + S + f" SELECT source, {_mean('quality_score')} AS avg_quality_score FROM s GROUP BY 1"
ORACLE["category_distribution"] = WITH + S + """ SELECT source, '{' || string_agg('"' || category || '":' || n::varchar, ',' ORDER BY category) || '}' AS category_distribution
 FROM (SELECT source, category, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1"""
ORACLE["call_outcomes"] = WITH + TELEMETRY + """ SELECT run_id, count(*) FILTER (starts_with(prompt_version, 'classification') AND status = 'ok') AS calls_ok,
 count(*) FILTER (starts_with(prompt_version, 'classification') AND status <> 'ok') AS calls_failed FROM tm GROUP BY 1"""
ORACLE["token_total"] = WITH + TELEMETRY + " SELECT run_id, count(*) AS calls, sum(tokens_in + tokens_out)::bigint AS tokens FROM tm GROUP BY 1"
ORACLE["sources_ranked"] = WITH + A + " SELECT source, count(*) AS articles FROM a GROUP BY 1"
CLASS = LABELLED + """, cl AS (SELECT unnest(['keep','drop','defer']) AS class),
 cc AS (SELECT class, count(*) FILTER (strict = class AND human = class) AS tp, count(*) FILTER (strict = class AND human <> class) AS fp,
 count(*) FILTER (strict <> class AND human = class) AS fn FROM cl CROSS JOIN lb GROUP BY class),
 pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) ELSE 0.0::double END AS pp, CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) ELSE 0.0::double END AS rr FROM cc),
 cm AS (SELECT class, round(pp, 3) AS precision, round(rr, 3) AS recall, round(CASE WHEN pp + rr > 0 THEN 2.0::double * pp * rr / (pp + rr) ELSE 0.0::double END, 3) AS f1, tp + fn AS support FROM pr)"""
ORACLE["class_metrics"] = WITH + CLASS + " SELECT * FROM cm"
ORACLE["macro_f1"] = WITH + CLASS + " SELECT round(avg(f1), 3) AS macro_f1, round(avg(f1), 3) >= 0.85::double AS passed FROM cm WHERE support > 0"
ORACLE["confusion_matrix"] = WITH + LABELLED + """ SELECT truth, count(*) FILTER (human = truth AND strict = 'keep') AS keep, count(*) FILTER (human = truth AND strict = 'drop') AS drop,
 count(*) FILTER (human = truth AND strict = 'defer') AS defer FROM (SELECT unnest(['keep','drop','defer']) AS truth) CROSS JOIN lb GROUP BY 1"""
ORACLE["agreement"] = WITH + LABELLED + " SELECT count(*) FILTER (strict = lenient) AS matches, count(*) AS total, (count(*) FILTER (strict = lenient) * 100) // count(*) AS percent FROM lb"
ORACLE["label_distribution"] = WITH + LABELLED + """ SELECT 'strict' AS labeler, strict AS label, count(*) AS articles FROM lb GROUP BY 2
 UNION ALL SELECT 'human', human, count(*) FROM lb GROUP BY 2"""
ORACLE["summarized_count"] = WITH + A + " SELECT count(*) FILTER (summary <> '') AS summarized, count(*) AS articles FROM a"
LEGACY = ST + """, lg AS (SELECT id, title, CASE WHEN id % 3 = 0 THEN 'country' ELSE category END AS category FROM st),
 fx AS (SELECT id, title, CASE WHEN category <> 'country' THEN category
 WHEN contains(lower(title), 'the') OR contains(lower(title), 'der') OR contains(lower(title), 'les') THEN 'startups'
 WHEN contains(lower(title), 'and') OR contains(lower(title), 'und') OR contains(lower(title), 'que') THEN 'policy' ELSE 'industry' END AS category FROM lg)"""
ORACLE["country_category_fix"] = WITH + LEGACY + " SELECT * FROM fx"
ORACLE["legacy_category_count"] = WITH + LEGACY + """ SELECT 'before' AS state, count(*) FILTER (category = 'country') AS articles FROM lg
 UNION ALL SELECT 'after', count(*) FILTER (category = 'country') FROM fx"""

ORACLE["first_n_per_source"] = WITH + A + """ SELECT seq, source, published_date FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM a)
 WHERE n <= 10 AND (published_date IS NULL OR published_date >= TIMESTAMP '2024-03-01' - INTERVAL 30 DAY)"""
ORACLE["ordered_dedup"] = WITH + A + """, f AS (SELECT seq, url, sha256(title || url || source) AS article_hash FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
 SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY article_hash ORDER BY seq) = 1"""
# the sequential walk itself, one row per step
ORACLE["ordered_dedup_two_keys"] = "WITH RECURSIVE " + A + """, o AS (SELECT seq, url, title, hash(url) AS u, hash(title) AS t, row_number() OVER (ORDER BY seq) AS n FROM a),
 walk AS (SELECT 0::bigint AS n, []::ubigint[] AS us, []::ubigint[] AS ts, false AS kept
 UNION ALL SELECT o.n, CASE WHEN k THEN list_append(us, o.u) ELSE us END, CASE WHEN k THEN list_append(ts, o.t) ELSE ts END, k
 FROM (SELECT w.n AS wn, w.us, w.ts, NOT list_contains(w.us, o.u) AND NOT list_contains(w.ts, o.t) AS k, o.* FROM walk w JOIN o ON o.n = w.n + 1) AS o)
 SELECT seq, url, title FROM o JOIN walk USING (n) WHERE kept"""
ORACLE["budget_gate"] = WITH + TELEMETRY + """ SELECT run_id, event_id, b AS tokens_before, b < 2000 AS allowed, greatest(0, 2000 - b) AS tokens_left FROM
 (SELECT *, coalesce(sum(tokens_in + tokens_out) OVER (PARTITION BY run_id ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS b FROM tm)"""
SAMPLE = A + """, x AS (SELECT seq, source, url, md5('42' || url) AS key, length(content) < 500 AS short FROM a),
 sz AS (SELECT source, count(*) AS size, greatest(1, round_even(200 * count(*)::double / (SELECT count(*) FROM x), 0)) AS quota FROM x GROUP BY 1),
 rk AS (SELECT x.*, row_number() OVER (PARTITION BY source ORDER BY key, seq) AS n FROM x),
 fl AS (SELECT rk.*, row_number() OVER (ORDER BY n <= quota DESC, key, seq) <= 200 AS in0 FROM rk JOIN sz USING (source)),
 sw AS (SELECT greatest(0, least(floor(200 * 0.3) - count(*) FILTER (in0 AND short), count(*) FILTER (NOT in0 AND short), count(*) FILTER (in0 AND NOT short))) AS k FROM fl),
 up AS (SELECT *, row_number() OVER (PARTITION BY in0, short ORDER BY key, seq) AS u, row_number() OVER (PARTITION BY in0, short ORDER BY key DESC, seq DESC) AS d FROM fl),
 smp AS (SELECT seq, url, source FROM up, sw WHERE (in0 AND (short OR d > k)) OR (NOT in0 AND short AND u <= k))"""
ORACLE["stratified_sample"] = WITH + SAMPLE + " SELECT * FROM smp"
ORACLE["sample_remainder"] = WITH + SAMPLE + " SELECT seq, source FROM a WHERE seq NOT IN (SELECT seq FROM smp)"
ORACLE["last_write_wins"] = WITH + A + " SELECT seq, title, source FROM a QUALIFY row_number() OVER (PARTITION BY title ORDER BY seq DESC) = 1"

ORACLE["article_page"] = WITH + ST + f" SELECT {PAGE} FROM st WHERE {PUBLISHED} ORDER BY coalesce(published_date, created_at) DESC, id LIMIT 50 OFFSET 20"
ORACLE["deep_page"] = WITH + ST + f" SELECT {PAGE} FROM st WHERE {PUBLISHED} ORDER BY coalesce(published_date, created_at) DESC, id LIMIT 50 OFFSET 90"
ORACLE["disagreements"] = WITH + LABELLED + """, df AS (SELECT * FROM lb WHERE strict <> human)
 SELECT doc_id, substr(title, 1, 50) AS title, strict, human, greatest(0, (SELECT count(*) FROM df) - 15) AS not_shown FROM df ORDER BY doc_id LIMIT 15"""
ORACLE["union_channels"] = WITH + A + f""" SELECT seq, title, url, source FROM a
 UNION ALL SELECT page_id + 4611686018427387904, {_PAGE_TITLE}, url, 'web' FROM pages"""
ORACLE["distinct_links"] = WITH + LK + " SELECT page_id, place, link FROM lk"

ORACLE["keyword_category"] = WITH + K + " SELECT seq, category FROM k"
ORACLE["detect_country"] = WITH + K + " SELECT seq, cty AS country FROM k1"
ORACLE["eu_relevance"] = WITH + K + " SELECT seq, eu_relevance FROM k"
ORACLE["keyword_classify"] = WITH + K + f" SELECT seq, {LABELS} FROM k"
_LIVE = "(mode = 'live' AND k.seq % 4 <> 3 AND o.valid)"
ORACLE["classify_modes"] = WITH + K + ", " + OUTCOME + f""" SELECT k.seq, mode,
 {', '.join(f'CASE WHEN {_LIVE} THEN o.{c} ELSE k.{c} END AS {c}' for c in ('category', 'country', 'eu_relevance', 'confidence'))},
 CASE WHEN {_LIVE} THEN 'model' ELSE 'keywords' END AS label_origin
 FROM k JOIN o ON o.seq = k.seq CROSS JOIN (SELECT unnest(['disabled','shadow','live']) AS mode)"""
ORACLE["model_outcome"] = WITH + OUTCOME + " SELECT * FROM o"
ORACLE["quality_score"] = WITH + S + " SELECT seq, quality_score FROM s"
SUMM = RESP + f""", ra AS (SELECT a.*, coalesce(r.status, 'unknown') AS sst, coalesce(r.error, '') AS ser, CASE WHEN r.status = 'ok' THEN r.text END AS stxt,
 coalesce(r.tokens_in + r.tokens_out, 0) AS stok FROM a LEFT JOIN r ON r.seq = a.seq AND r.stage = 'summary'), """ + _summary_parse("stxt", "ra", "q")
ORACLE["choose_summary"] = WITH + A + ", " + SUMM + """ SELECT seq, CASE WHEN length(content) >= 200 AND seq % 4 <> 3 AND sst = 'ok' AND svalid AND stext <> 'NOT_RELEVANT' THEN stext ELSE summary END AS summary,
 length(content) >= 200 AND seq % 4 <> 3 AS summary_called, CASE WHEN sst = 'ok' AND NOT svalid THEN 'parse_error' ELSE sst END AS status FROM q"""
ORACLE["apply_reclassification"] = WITH + RECLASS + f""" SELECT st.id, st.title, CASE WHEN o.seq IS NOT NULL AND {CHANGED} THEN o.category ELSE st.category END AS category,
 CASE WHEN o.seq IS NOT NULL AND {CHANGED} THEN o.country ELSE st.country END AS country,
 CASE WHEN o.seq IS NOT NULL AND {CHANGED} THEN o.eu_relevance ELSE st.eu_relevance END AS eu_relevance,
 CASE WHEN o.seq IS NOT NULL THEN o.confidence ELSE st.confidence END AS confidence
 FROM st LEFT JOIN (SELECT * FROM o WHERE valid) o ON o.seq = st.id"""
ORACLE["store_update"] = "SELECT *, 'run-' || (id % 7)::varchar AS run_id FROM (" + ORACLE["apply_reclassification"] + ")"
ORACLE["normalize_store_sources"] = WITH + A + " SELECT seq, url, source FROM a"
ORACLE["classification_summary"] = WITH + OUTCOME + """ SELECT count(*) AS classified, count(*) FILTER (seq % 4 <> 3 AND status = 'ok') AS calls_ok,
 count(*) FILTER (seq % 4 <> 3 AND status <> 'ok') AS calls_failed, count(*) FILTER (seq % 4 = 3) AS budget_skipped, 0::bigint AS keyword_only FROM o"""
# the run: dedup, budget over both stages, labels, summary, score, gate, store
PIPE = K + ", " + OUTCOME + f""", dd AS (SELECT k.* FROM k QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
 calls AS (SELECT dd.seq, 0 AS stage, coalesce(r.tokens_in + r.tokens_out, 0) AS tok FROM dd LEFT JOIN r ON r.seq = dd.seq AND r.stage = 'classification'
 UNION ALL SELECT dd.seq, 1, coalesce(r.tokens_in + r.tokens_out, 0) FROM dd LEFT JOIN r ON r.seq = dd.seq AND r.stage = 'summary' WHERE length(content) >= 200),
 gate AS (SELECT seq, stage, coalesce(sum(tok) OVER (ORDER BY stage, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100000 AS ok FROM calls),
 ra AS (SELECT dd.seq, dd.content, dd.title, dd.url, dd.source, dd.published_date, dd.summary AS old_summary,
 {', '.join(f'CASE WHEN g0.ok AND o.valid THEN o.{c} ELSE dd.{c} END AS {c}' for c in ('category', 'country', 'eu_relevance', 'confidence'))},
 coalesce(g1.ok, false) AS sok, coalesce(rs.status, 'unknown') AS sst, CASE WHEN rs.status = 'ok' THEN rs.text END AS stxt
 FROM dd JOIN o ON o.seq = dd.seq JOIN gate g0 ON g0.seq = dd.seq AND g0.stage = 0 LEFT JOIN gate g1 ON g1.seq = dd.seq AND g1.stage = 1
 LEFT JOIN r rs ON rs.seq = dd.seq AND rs.stage = 'summary'), {_summary_parse('stxt', 'ra', 'q')},
 sm AS (SELECT *, CASE WHEN sok AND sst = 'ok' AND svalid AND stext <> 'NOT_RELEVANT' THEN stext ELSE old_summary END AS summary FROM q),
 {_quality('sm', 'sc')}, known AS (SELECT url FROM a WHERE seq % 10 = 0)"""
ORACLE["article_pipeline"] = WITH + PIPE + """ SELECT seq, url, title, source, category, nullif(country, '') AS country, quality_score, nullif(eu_relevance, 0) AS eu_relevance,
 nullif(confidence, 0) AS confidence, sha256(url || '|' || title) AS content_hash, nullif(summary, '') AS summary, published_date, TIMESTAMP '2024-03-01' AS created_at
 FROM sc WHERE quality_score >= 0.5::double AND url NOT IN (SELECT url FROM known)"""

# the feed channel: feed entries cut, dated and joined to their pages
_DATE = "CASE WHEN idx % 7 <> 0 THEN TIMESTAMP '2024-01-01 06:30:00' + (idx % 60) * INTERVAL 1 DAY END"
FEED = ITEMS + f""", g AS (SELECT 'https://feed.example/' || (page_id * 3)::varchar AS page_url, {_PAGE_TEXT} AS page_text FROM pages),
e1 AS (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY idx) AS place, {_DATE} AS published_date,
 coalesce(nullif({_clean('full_text')}, ''), nullif({_clean('summary')}, '')) AS own FROM e),
e2 AS (SELECT e1.*, coalesce(g.page_text, '') AS page_text FROM e1 LEFT JOIN g ON g.page_url = nullif(e1.link, '')
 WHERE place <= 10 AND (published_date IS NULL OR published_date >= TIMESTAMP '2024-03-01' - INTERVAL 30 DAY)),
fa AS (SELECT source_rank * 10 + place - 1 AS seq, title, link AS url, {ALIAS.replace('source', 'feed_title')} AS source,
 CASE WHEN length(page_text) < 200 AND length(own) > length(page_text) THEN own ELSE page_text END AS content, summary, published_date,
 CASE WHEN media_url IS NOT NULL THEN media_url WHEN idx % 3 = 0 THEN 'https://img.example/e' || idx::varchar || '.png' END AS image_url FROM e2)"""
ORACLE["feed_channel"] = WITH + FEED + " SELECT * FROM fa"
# both channels as the articles of a run
COLLECTED = FEED + ", wa AS (" + ORACLE["page_scan"] + """),
a AS (SELECT seq, title, url, source, content, summary, published_date, image_url FROM fa
 UNION ALL SELECT seq + 4611686018427387904, title, url, source, content, summary, published_date, image_url FROM wa)"""
RUN = COLLECTED + PIPE[len(A):].replace("d.doc_id AS seq", "d.seq AS seq").replace(
    "FROM documents d LEFT JOIN r ON r.seq = d.doc_id", "FROM a d LEFT JOIN r ON r.seq = d.seq")
RUN += """, new AS (SELECT * FROM sc WHERE quality_score >= 0.5::double AND url NOT IN (SELECT url FROM known))"""
ORACLE["full_run"] = WITH + RUN + """ SELECT (SELECT count(DISTINCT url) FROM known) + row_number() OVER (ORDER BY seq) AS id, url, title, source, category,
 nullif(country, '') AS country, quality_score, nullif(eu_relevance, 0) AS eu_relevance, nullif(confidence, 0) AS confidence,
 sha256(url || '|' || title) AS content_hash, nullif(summary, '') AS summary, published_date, image_url FROM new LEFT JOIN (SELECT seq, image_url FROM a) USING (seq)"""
ORACLE["full_run_metrics"] = WITH + RUN + f""" SELECT 'run-1' AS run_id, source AS source_name, count(DISTINCT a.seq) AS articles_fetched, (SELECT count(*) FROM new WHERE new.source = a.source) AS articles_stored,
 (SELECT count(*) FROM sc WHERE sc.source = a.source AND eu_relevance >= 3) AS articles_passed_relevance,
 (SELECT {_mean('eu_relevance')} FROM sc WHERE sc.source = a.source) AS avg_eu_relevance, (SELECT {_mean('quality_score')} FROM sc WHERE sc.source = a.source) AS avg_quality_score,
 (SELECT '{{' || string_agg('"' || c || '":' || n::varchar, ',' ORDER BY c) || '}}' FROM (SELECT category AS c, count(*) AS n FROM sc WHERE sc.source = a.source AND category <> '' GROUP BY 1)) AS category_distribution
 FROM a GROUP BY source"""
ORACLE["full_run_telemetry"] = WITH + RUN + """ SELECT 'run-1' AS run_id, dd.url AS article_url, coalesce(r.model, '') AS model,
 CASE WHEN g.stage = 0 THEN 'classification' ELSE 'summary' END AS prompt_version,
 coalesce(r.latency_ms, 0) AS latency_ms, coalesce(r.tokens_in, 0) AS tokens_in, coalesce(r.tokens_out, 0) AS tokens_out,
 CASE WHEN g.stage = 0 THEN o.status WHEN q.sst = 'ok' AND NOT q.svalid THEN 'parse_error' ELSE q.sst END AS status
 FROM gate g JOIN dd ON dd.seq = g.seq LEFT JOIN r ON r.seq = g.seq AND r.stage = CASE WHEN g.stage = 0 THEN 'classification' ELSE 'summary' END
 JOIN o ON o.seq = g.seq JOIN q ON q.seq = g.seq WHERE g.ok"""
ORACLE["stream_ingest_store"] = WITH + S + " SELECT seq, url, source, category, quality_score, sha256(url || '|' || title) AS content_hash FROM s QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1"
ORACLE["stream_feed_ingest"] = WITH + FEED.replace("PARTITION BY source_rank ORDER BY idx", "PARTITION BY feed_title, idx // 1000 ORDER BY idx") + """
 SELECT url, title, source, sha256(url || '|' || title) AS content_hash, published_date, image_url FROM fa WHERE url <> ''"""
ORACLE["stream_source_metrics"] = WITH + S + f""", w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, created_at) AS ws FROM s)
 SELECT ws AS window_start, ws + INTERVAL 6 HOUR AS window_end, source, count(*) AS articles, count(*) FILTER (eu_relevance >= 3) AS passed_relevance,
 {_mean('eu_relevance')} AS avg_eu_relevance, {_mean('quality_score')} AS avg_quality_score,
 (SELECT '{{' || string_agg('"' || c || '":' || n::varchar, ',' ORDER BY c) || '}}' FROM (SELECT category AS c, count(*) AS n FROM w w2
  WHERE w2.source IS NOT DISTINCT FROM w.source AND w2.ws = w.ws AND category <> '' GROUP BY 1)) AS category_distribution,
 ws + INTERVAL 6 HOUR <= (SELECT max(created_at) FROM s) - INTERVAL 1 HOUR AS final FROM w GROUP BY ws, source"""
ORACLE["stream_dedup_url"] = WITH + A + " SELECT DISTINCT url, title FROM a"
