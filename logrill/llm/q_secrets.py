"""Query: the secrets of every document, by kind and place."""

from pyspark.sql import functions as F

from logrill.llm.common import table
from logrill.llm.secrets import BASE, MORE, scan


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), [*BASE, *MORE])
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))

    def n(i):
        return F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long").alias(f"n_{kinds[i]}")

    return found.select("row.doc_id", n(0), n(1), n(2), F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def _quoted(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _spans(i: int, rule) -> str:
    """Starts and ends by running sums over the pieces around the matches; every rule over every text."""
    r = _quoted(rule.regex)
    return f"""
  SELECT row, unnest(list_transform(list_filter(range(1, len(f) + 1), lambda i: length(g[i]) >= {rule.least}), lambda i: {{
    'start': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
    'rule': {i}, 'kind': '{rule.kind}', 'n': length(f[i])}})) AS s
  FROM (SELECT row, regexp_split_to_array(t, {r}) AS p, regexp_extract_all(t, {r}) AS f, regexp_extract_all(t, {r}, {rule.group}) AS g
        FROM d WHERE regexp_matches(t, {r}))"""


_ALL = " UNION ALL ".join(_spans(i, r) for i, r in enumerate([*BASE, *MORE]))
_TEXT = "s.kind || ':' || s.start || ':' || (s.start + s.n), ',' ORDER BY s.start, s.rule"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_ALL}),
a AS (SELECT row, count(*) FILTER (s.rule = 0) AS n_assign, count(*) FILTER (s.rule = 1) AS n_access,
        count(*) FILTER (s.rule = 2) AS n_hex,
        string_agg({_TEXT}) FILTER (s.rule < {len(BASE)}) AS base, string_agg({_TEXT}) AS spans
      FROM m GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row)
"""
