"""Query: documents that hold a benchmark item, or its template with consistent other values."""

from logrill.llm.common import table
from logrill.llm.decontaminate import NAME, NUMBER, UNIT, UNITS, leaks

_MARKS = f"('{NUMBER}', '{UNIT}', '{NAME}')"
_UNITS = "[" + ", ".join(f"'{u}'" for u in UNITS) + "]"


def _template(table_: str, key: str) -> str:
    """Rows (key, pos, form, raw) of words with their template word; separators stay with the word that follows."""
    return f"""
  SELECT {key}, pos, raw, CASE WHEN regexp_matches(raw, '^\\d') THEN '{NUMBER}'
      WHEN list_contains({_UNITS}, lower(raw)) AND coalesce(regexp_matches(before, '^\\d'), false) THEN '{UNIT}'
      WHEN regexp_matches(w, '[,;)]\\x20\\p{{Lu}}\\p{{Ll}}\\p{{L}}*$')
        OR (regexp_matches(w, '^\\x20\\p{{Lu}}\\p{{Ll}}') AND regexp_matches(before, '^[\\p{{L}}\\d]')) THEN '{NAME}'
      ELSE lower(raw) END AS form
  FROM (SELECT *, lag(raw) OVER (PARTITION BY {key} ORDER BY pos) AS before FROM (
    SELECT {key}, pos, w, regexp_replace(w, '^[^\\p{{L}}\\d%$€£]*', '') AS raw FROM (
      SELECT {key}, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS pos FROM (
        SELECT {key}, regexp_extract_all(coalesce(text, ''), '[^\\p{{L}}\\d%$€£]*(?:\\d+(?:[.,]\\d+)*|\\p{{L}}+|[%$€£])') AS w
        FROM {table_}))))"""


def _windows(table_: str, key: str) -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)"
    return f"""
  SELECT {key}, pos, f, list_transform(list_filter(list_zip(f, r), lambda x: x[1] IN {_MARKS}), lambda x: lower(x[2])) AS s
  FROM (SELECT {key}, pos, list(form) {over} AS f, list(raw) {over} AS r FROM ({_template(table_, key)}))
  WHERE len(f) = 8"""


SQL = f"""
WITH i AS (SELECT item_id, f, arg_min(s, pos) AS s FROM ({_windows('benchmark', 'item_id')})
  WHERE len(list_filter(f, lambda w: w NOT IN {_MARKS})) >= 4
    AND len(list_distinct(list_filter(f, lambda w: w NOT IN {_MARKS}))) >= 3 GROUP BY ALL),
n AS (SELECT item_id, count(*) AS n_item_windows FROM i GROUP BY ALL),
d AS ({_windows('documents', 'doc_id')}),
w AS (SELECT DISTINCT doc_id, item_id, f, i.s AS i, d.s AS d FROM d JOIN i USING (f)
  WHERE len(list_distinct(i.s)) = len(list_distinct(list_zip(i.s, d.s)))
    AND len(list_distinct(d.s)) = len(list_distinct(list_zip(i.s, d.s)))),
v AS (SELECT DISTINCT doc_id, item_id, f, i AS si, d AS sd, unnest(i) AS i, unnest(d) AS d FROM w),
c AS (SELECT doc_id, item_id, i, d, row_number() OVER (PARTITION BY doc_id, item_id, i ORDER BY count(*) DESC, d DESC) AS r
  FROM v GROUP BY doc_id, item_id, i, d),
o AS (SELECT DISTINCT v.doc_id, v.item_id, v.si, v.sd, v.f FROM v JOIN c ON c.r = 1 AND v.doc_id = c.doc_id
  AND v.item_id = c.item_id AND v.i = c.i AND v.d <> c.d),
p AS (SELECT doc_id, item_id, f, max(i = d) AS same FROM w
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = w.doc_id AND o.item_id = w.item_id AND o.f = w.f AND o.si = w.i AND o.sd = w.d)
  GROUP BY ALL),
h AS (SELECT doc_id, item_id, count(*) AS n_windows, min(same) AS slots_equal FROM p GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_item_windows, n_windows / n_item_windows AS share, slots_equal
FROM h JOIN n USING (item_id) WHERE n_windows / n_item_windows >= 0.5
"""


def query(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
