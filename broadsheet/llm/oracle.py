"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

SP = r"[^\x20\x09-\x0D]+"

def _url_levels(deepest: int) -> str:
    """Wildcards from the first level down, merged branches from the last one up; the paths of
    the given pages have fewer levels than ``deepest``."""
    steps = []
    for k in range(1, deepest + 1):
        steps.append(f"""places{k} AS (
  SELECT host, s[1:{k}] AS above FROM wild{k - 1} WHERE len(s) > {k} GROUP BY ALL
  HAVING count(DISTINCT s[{k + 1}]) >= 8 AND sum(n) <= 2 * count(DISTINCT s[{k + 1}])),
wild{k} AS (
  SELECT w.* REPLACE (CASE WHEN p.host IS NULL THEN w.s
                      ELSE w.s[1:{k}] || ['*'] || w.s[{k + 2}:] END AS s)
  FROM wild{k - 1} w LEFT JOIN places{k} p
    ON p.host = w.host AND len(w.s) > {k} AND p.above = w.s[1:{k}])""")
    steps.append(f"""overall AS (SELECT (sum(b) + 1) / (sum(l) + 2) AS p0 FROM wild{deepest}),
named{deepest + 1} AS (SELECT * FROM wild{deepest})""")
    for k in range(deepest, 0, -1):
        steps.append(f"""branches{k} AS (
  SELECT host, s[1:{k}] AS above, s[{k + 1}] AS branch,
         count(DISTINCT (len(s), array_to_string(s[{k + 2}:], '/'))) AS k,
         min(array_to_string(s[{k + 2}:], '/')) AS lo, max(array_to_string(s[{k + 2}:], '/')) AS hi,
         min(len(s)) AS short, sum(b) AS bb, sum(l) AS bl
  FROM named{k + 1} WHERE len(s) > {k} GROUP BY ALL),
everywhere{k} AS (SELECT above, branch, sum(bb) AS ab, sum(bl) AS al FROM branches{k} GROUP BY ALL),
evidence{k} AS (
  SELECT branches{k}.*, greatest(bl + 4, 16) AS el,
         bb + (greatest(bl + 4, 16) - bl) * ((ab + 4 * p0) / (al + 4)) AS eb
  FROM branches{k} JOIN everywhere{k} USING (above, branch), overall),
pooled{k} AS (
  SELECT *, sum(eb) OVER (PARTITION BY host, above, k, lo, hi, short)
            / sum(el) OVER (PARTITION BY host, above, k, lo, hi, short) AS q
  FROM evidence{k}),
kin{k} AS (
  SELECT host, above, branch, min(branch) OVER (PARTITION BY host, above, k, lo, hi, short,
           CASE WHEN (eb - el * q) * (eb - el * q) > 3.84 * (el * q * (1 - q))
           THEN sign(eb - el * q) ELSE 0 END) AS kin
  FROM pooled{k}),
named{k} AS (
  SELECT t.* REPLACE (CASE WHEN y.kin IS NULL THEN t.s
                      ELSE t.s[1:{k}] || [y.kin] || t.s[{k + 2}:] END AS s)
  FROM named{k + 1} t LEFT JOIN kin{k} y
    ON y.host = t.host AND len(t.s) > {k} AND y.above = t.s[1:{k}] AND y.branch = t.s[{k + 1}])""")
    return ",\n".join(steps)


_HEX = r"""'(^|/)[0-9a-fA-F-]{16,}($|/)', '\1{h}\2', 'g')"""
ORACLE["op3_url_filters"] = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
ruled AS (
  SELECT page_id, host, path,
         (SELECT r.rule FROM rules r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost))
          AND starts_with(p.path, r.rpath) ORDER BY length(r.rule) DESC LIMIT 1) AS rule,
         -- a match takes the slash behind it, so every second of neighbours needs another pass
         regexp_replace(regexp_replace(regexp_replace(path, HEX, HEX, '[0-9]+', '{n}', 'g') AS shape
  FROM parsed p),
judged AS (
  SELECT u.*, r.verdict AS rv, CASE r.verdict WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label
  FROM ruled u LEFT JOIN rules r ON u.rule = r.rule),
wild0 AS (
  SELECT host, shape, CASE WHEN contains(shape, '/') THEN string_split(shape, '/')
                      ELSE [shape, ''] END AS s,
         count(*) AS n, sum(coalesce(label, 0)) AS b, count(label) AS l
  FROM judged GROUP BY ALL),
LEVELS,
named AS (SELECT host, shape, b, l, array_to_string(s, '/') AS template FROM named1),
own AS (SELECT host, template, sum(b) AS b, sum(l) AS l FROM named GROUP BY ALL),
anywhere AS (SELECT template, sum(b) AS ab, sum(l) AS al FROM own GROUP BY ALL),
purity AS (
  SELECT host, template, (b + 4 * ((ab + 4 * p0) / (al + 4))) / (l + 4) AS purity
  FROM own JOIN anywhere USING (template), overall)
SELECT j.page_id, j.host, j.path, j.rule, n.template, p.purity,
       coalesce(j.rv, CASE WHEN p.purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN named n USING (host, shape) JOIN purity p USING (host, template)
""".replace("HEX", _HEX).replace("LEVELS", _url_levels(6))

ORACLE["op10_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u,
         md5(coalesce(text, '')) AS digest
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER w AS rank, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bound,
         sum(weight) OVER ()
           - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
l AS (SELECT *, (total - bound) / remaining AS level FROM o),
f AS (SELECT min({'rank': rank, 'level': level}) AS final FROM l WHERE level * weight <= 2 * source_size),
t AS (
  SELECT source, source_size,
         CASE WHEN rank >= final.rank THEN final.level * weight ELSE 2.0::DOUBLE * source_size END AS target
  FROM l, f),
r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM t),
ranked AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         sum(d.size) OVER (PARTITION BY r.source ORDER BY u, d.size, d.digest ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

ORACLE["op5_warc"] = r"""
WITH p AS (
  SELECT page_id, sha1(encode(coalesce(html, ''))) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
k AS (
  SELECT digest, n, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k USING (digest, n)
"""

ORACLE["op2_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS r FROM s
  UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.a)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links,
       (SELECT min(r) FROM reach WHERE reach.a = s.doc_id) AS component_id
FROM s
"""

ORACLE["op12_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         [coalesce(role, ''), coalesce(text, '')] AS said
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, xor(list_reduce(
           list_prepend(4294967295::BIGINT,
                        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z:
             CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
         4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT i.conv_id, b.pos, b.said FROM ids i
  JOIN t b ON b.conv_id = i.conv_id - i.conv_id % 20 AND b.pos <= i.h
  UNION ALL SELECT conv_id, pos, said FROM t JOIN ids USING (conv_id) WHERE pos > h),
c AS (
  SELECT i.conv_id, coalesce(list(r.said ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS path
  FROM ids i LEFT JOIN r USING (conv_id) GROUP BY i.conv_id),
m AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM c),
n AS (
  SELECT path[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth) AS ends
  FROM m GROUP BY path[1:depth], depth),
k AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
g AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0
           ELSE len(regexp_extract_all(p[depth][2], '[^\x20\x09-\x0D]+')) END AS gain
  FROM n LEFT JOIN k USING (p)),
s AS (
  SELECT p[1:up] AS p, sum(gain) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM g) GROUP BY 1)
SELECT g.conv_id, g.depth, o.conv_id AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN s USING (p) LEFT JOIN n o ON g.depth > 0 AND o.p = g.p[1:g.depth - 1]
"""
