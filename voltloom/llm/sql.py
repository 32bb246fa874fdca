"""The registered queries in DuckDB SQL, where SQL can express them on whole tables."""

#: Site rules and pattern rules, the longest site rule first.
URL_FILTERS = r"""
WITH cut AS (
  SELECT page_id, regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1) AS raw_host,
         regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS raw_path FROM pages),
parts AS (SELECT page_id, translate(coalesce(raw_host, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(raw_path, '') AS path FROM cut),
rules(rule_host, rule_path, does) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, does,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC,
                            does = 'allow', rule_host || rule_path) AS place
  FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule,
       CASE WHEN f.does IS NOT NULL THEN f.does
            WHEN regexp_full_match(p.host, '(?s:(.*[.-])?(ads|ad|tracker|casino|porn)([.-].*)?)') THEN 'block'
            WHEN regexp_full_match(p.path, '(?s:(.*/)?wp-login([./].*)?)') AND p.host || p.path <> '' THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""

#: Queries meet all rows in whole-number inner products.
TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS n
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(list_zip(q.n, d.n), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(d.n) = len(q.n)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""

#: Pairs of a label by cosine; components by repeated reach (groups of copies are small at this scale).
EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
able AS (
  SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.norm > 0 AND b.norm > 0
    AND list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) >= 0.98 * a.norm * b.norm),
reach AS (
  SELECT DISTINCT a AS origin, a AS node FROM links
  UNION
  SELECT r.origin, l.b FROM reach r JOIN links l ON r.node = l.a),
lowest AS (SELECT origin, min(node) AS component_id FROM reach GROUP BY origin),
number AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
       CAST(coalesce(c.component_id, e.vec_id) AS BIGINT) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN number n ON n.a = e.vec_id LEFT JOIN lowest c ON c.origin = e.vec_id
"""

SQL = {
    "op2_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op4_url_filters": URL_FILTERS,
    "op8_exact_top_k": TOP_K,
}
