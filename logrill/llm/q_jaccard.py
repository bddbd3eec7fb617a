"""Query: components of documents whose three-word shingle sets have a Jaccard similarity of 0.9 or more."""

from logrill.llm.common import table
from logrill.llm.jaccard import jaccard_components

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 90 * (na + nb - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS to_id FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.to_id = u.a),
c AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM s LEFT JOIN c ON c.id = doc_id
"""


def query(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
