"""DuckDB SQL with the rows of the queries of this subpackage."""

EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

LINES = """
WITH parts AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts
), spread AS (
  SELECT line, min({'doc_id': doc_id, 'pos': pos}) AS first FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY line HAVING count(DISTINCT source) >= 8
), gone AS (
  SELECT l.doc_id, count(*) AS n FROM lines l JOIN spread s USING (line)
  WHERE NOT (l.doc_id = s.first.doc_id AND l.pos = s.first.pos) GROUP BY l.doc_id
), rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN spread s USING (line)
  WHERE s.line IS NULL OR (l.doc_id = s.first.doc_id AND l.pos = s.first.pos) GROUP BY l.doc_id
)
SELECT p.doc_id, len(p.lines) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(r.text, '')) AS text_sha256
FROM parts p LEFT JOIN gone g USING (doc_id) LEFT JOIN rest r USING (doc_id)
"""

URLS = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

LEAKS = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM item_words WHERE len(w) > 0
), starts AS (
  SELECT item_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM sized
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM starts
), places AS (
  SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM doc_words, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n
), found AS (
  SELECT p.doc_id, p.i, p.n, k.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places) p JOIN windows k ON p.gram = k.gram AND p.n = k.n
), hits AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, CAST(len(w) - 1 AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
), sizes AS MATERIALIZED (
  SELECT doc_id, len(g) AS n FROM grams
), posted AS MATERIALIZED (
  SELECT doc_id, n, unnest(g) AS s FROM grams JOIN sizes USING (doc_id)
), links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM posted a JOIN posted b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), sym AS MATERIALIZED (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, b.v FROM reached r JOIN sym b ON r.other = b.u
), least_ AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least_ USING (doc_id)
"""
