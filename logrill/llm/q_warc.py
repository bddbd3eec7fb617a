"""Query: every page archived and read back, one row per capture."""

from logrill.llm.common import table
from logrill.llm.warc import page_captures

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
# five hexadecimal digits are four letters of base32
_WORD = "CAST('0x' || substr(sha1(h), {at}, 5) AS BIGINT)"
_BASE32 = " || ".join(
    f"substr({_LETTERS}, CAST(({_WORD.format(at=5 * i + 1)} >> {shift}) & 31 AS INTEGER) + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0))

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, {_BASE32.replace('sha1(h)', 'sha1(p.h)')} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""


def query(spark, sf_dir):
    return page_captures(spark, table(spark, sf_dir, "pages"))
