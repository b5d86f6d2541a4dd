"""DuckDB statements of the queries that SQL can express, written from the definitions alone."""

from __future__ import annotations

# Eight pages or three labels for a branch of its own, 1.5 standard errors, strength 8, limit 0.5; paths of up to twelve segments.
_LEVEL = """
e{i} AS MATERIALIZED (SELECT node, seg[{j}] AS s, any_value(up) AS up, count(*) >= 8 OR sum(n) >= 3 AS own, sum(b) AS b, sum(n) AS n FROM r{i} WHERE len(seg) >= {j} GROUP BY node, seg[{j}]),
a{i} AS MATERIALIZED (SELECT node, b, n, min(s) AS s1, count(*) AS many, (b + 8.0 * any_value(prior)) / (n + 8.0) AS r FROM e{i} CROSS JOIN whole WHERE own GROUP BY node, b, n),
l{i} AS MATERIALIZED (SELECT *, lag(r) OVER k AS r0, lag(n) OVER k AS n0 FROM a{i} WINDOW k AS (PARTITION BY node ORDER BY r, n)),
g{i} AS MATERIALIZED (SELECT *, sum(CASE WHEN r - r0 > 1.5 * sqrt((r + r0) / 2 * (1 - (r + r0) / 2) * (1 / (n + 8.0) + 1 / (n0 + 8.0))) THEN 1 ELSE 0 END)
  OVER (PARTITION BY node ORDER BY r, n ROWS UNBOUNDED PRECEDING) AS grp FROM l{i}),
b{i} AS MATERIALIZED (SELECT node, b, n, true AS own, min(s1) OVER (PARTITION BY node, grp) || CASE WHEN sum(many) OVER (PARTITION BY node, grp) > 1
  THEN '|+' || CAST(CAST(sum(many) OVER (PARTITION BY node, grp) - 1 AS BIGINT) AS VARCHAR) ELSE '' END AS branch FROM g{i}),
c{i} AS MATERIALIZED (SELECT e{i}.*, node || '/' || coalesce(branch, '*') AS child FROM e{i} LEFT JOIN b{i} USING (node, b, n, own)),
p{i} AS MATERIALIZED (SELECT child, (sum(b) + 8.0 * any_value(up)) / (sum(n) + 8.0) AS share FROM c{i} GROUP BY child),
r{j} AS MATERIALIZED (SELECT r{i}.* EXCLUDE (node, up), coalesce(child, r{i}.node) AS node, coalesce(share, r{i}.up) AS up FROM r{i}
  LEFT JOIN c{i} ON r{i}.node = c{i}.node AND r{i}.seg[{j}] = c{i}.s LEFT JOIN p{i} USING (child)),"""

URL_FILTER = """
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
marks AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
split AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg,
  try_cast(regexp_extract(path, '([0-9]+)(?:\\.[a-z]+)?/?$', 1) AS BIGINT) AS doc_id FROM named),
marked AS MATERIALIZED (SELECT page_id, host, path, seg, coalesce(bad, 0) AS b, CASE WHEN bad IS NULL THEN 0 ELSE 1 END AS n FROM split LEFT JOIN marks USING (doc_id)),
whole AS MATERIALIZED (SELECT CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) ELSE 0.2 END AS prior FROM marked),
hosts AS MATERIALIZED (SELECT host, (sum(b) + 8.0 * any_value(prior)) / (sum(n) + 8.0) AS up FROM marked CROSS JOIN whole GROUP BY host),
r0 AS MATERIALIZED (SELECT marked.*, host AS node, up FROM marked JOIN hosts USING (host)),
""" + "".join(_LEVEL.format(i=i, j=i + 1) for i in range(12)) + """
ruled AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM r12)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN up >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, node AS template, round(up, 9) AS purity FROM ruled
"""

# k1 1.2, b 0.75, all terms of a query, its ten best documents.
BM25 = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')) AS term FROM documents),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
len AS MATERIALIZED (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
whole AS MATERIALIZED (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) / (SELECT count(*) FROM documents) AS mean),
freq AS MATERIALIZED (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post CROSS JOIN whole GROUP BY term),
weighed AS MATERIALIZED (SELECT doc_id, term, CAST(round(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) * 1000000) AS BIGINT) AS impact
  FROM post JOIN freq USING (term) JOIN len USING (doc_id) CROSS JOIN whole),
asked AS MATERIALIZED (SELECT doc_id AS q, term FROM weighed WHERE doc_id % 20 = 0),
hits AS (SELECT q, p.doc_id, sum(impact) AS score FROM asked JOIN weighed p USING (term) GROUP BY q, p.doc_id)
SELECT q AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, CAST(score AS DOUBLE) / 1000000 AS score FROM hits WHERE score > 0
WINDOW w AS (PARTITION BY q ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10
"""

LINE_DEDUP = r"""
WITH cut AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS MATERIALIZED (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
keyed AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
shared AS MATERIALIZED (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS MATERIALIZED (SELECT k.*, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Scale 4096, eight parts, sixteen entries, six rounds and a last assignment.
_ROUND = """
far{i} AS MATERIALIZED (SELECT row_no, d.part, c.entry, sum((v - c.value) * (v - c.value)) AS apart FROM comp d JOIN book{i} c ON d.part = c.part AND d.place = c.place GROUP BY ALL),
near{i} AS MATERIALIZED (SELECT row_no, part, entry, apart FROM far{i} QUALIFY row_number() OVER (PARTITION BY row_no, part ORDER BY apart, entry) = 1),"""
_MOVE = """
mean{i} AS MATERIALIZED (SELECT d.part, entry, place, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS value FROM comp d JOIN near{i} USING (row_no, part) GROUP BY ALL),
book{j} AS MATERIALIZED (SELECT part, entry, place, coalesce(m.value, b.value) AS value FROM book{i} b LEFT JOIN mean{i} m USING (part, entry, place)),"""
VECTOR_CODES = """
WITH fit AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row_no, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
flat AS MATERIALIZED (SELECT row_no, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v, generate_subscripts(embedding, 1) - 1 AS k, len(embedding) // 8 AS wide FROM fit),
comp AS MATERIALIZED (SELECT row_no, k // wide AS part, k % wide AS place, v FROM flat),
book0 AS MATERIALIZED (SELECT part, row_no - 1 AS entry, place, v AS value FROM comp WHERE row_no <= 16),""" + "".join(
    _ROUND.format(i=i) + (_MOVE.format(i=i, j=i + 1) if i < 6 else "") for i in range(7)) + """
digest AS (SELECT sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book6),
coded AS MATERIALIZED (SELECT row_no, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(apart) AS BIGINT) AS error FROM near6 GROUP BY row_no)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN fit USING (row_no) CROSS JOIN digest
"""

LEXICAL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')) AS term FROM documents),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
len AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY doc_id),
whole AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
asked AS MATERIALIZED (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')) AS term FROM benchmark)),
freq AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post CROSS JOIN whole GROUP BY term),
short AS MATERIALIZED (SELECT doc_id, 100 - 90 + ((90 * n * n_docs) // n_terms) AS m FROM len CROSS JOIN whole),
hits AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN freq USING (term) JOIN post USING (term) JOIN short USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER k AS INTEGER) AS rank, doc_id, score FROM hits WHERE score > 0
WINDOW k AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER k <= 10
"""
