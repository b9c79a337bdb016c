"""DuckDB SQL for the operators that it can express, by comparing all with all: for small tables."""

_WALK = """walk AS (
  SELECT id AS node, id AS root FROM items
  UNION SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.node WHERE w.root < l.b),
reached AS (SELECT node, min(root) AS component_id FROM walk GROUP BY node)"""

OP3 = rf"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (na + nb - common)),
items AS (SELECT doc_id AS id FROM documents),
{_WALK}
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept,
  CASE WHEN len(s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY s) END AS class_id
FROM sets s JOIN reached r ON r.node = s.doc_id"""

OP10 = f"""WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
items AS (SELECT vec_id AS id FROM embeddings),
{_WALK}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN reached ON node = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id"""
