"""Archives: round trip of payloads, captures, revisits and odd pages."""

import gzip

from logrill.llm.warc import assemble, digest, page_captures, parse, read_records, write_archives
from logrill.session import fresh_path

PAGES = "page_id long, url string, html string, record_id string"
ROWS = [(3, "http://a.example/x", "one\r\n\r\nWARC/1.1\r\n\r\n two", "r"), (1, None, "same", "r"), (2, "http://b.example", "same", None),
        (2, "http://b.example", "same", None), (4, "http://c.example/\r\nX: y", None, "r"), (5, "", "", "r"),
        (None, "http://d.example", "same", "r"), (6, "http://e.example/é", "é" * 50_000, "r")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    path = fresh_path(spark, "warc_test")
    write_archives(pages, path, archive_records=5)
    records = read_records(spark, path)
    assert records.where("type = 'response' AND NOT payload_ok").count() == 0
    captures = assemble(records).collect()
    assert len(captures) == len(ROWS)  # the repeated row is a capture, too
    payloads = {bytes(r["main"]["payload"]).decode() for r in captures if r["main"]["type"] == "response"}
    assert payloads == {"one\r\n\r\nWARC/1.1\r\n\r\n two", "same", "", "é" * 50_000}
    for r in captures:
        assert r["request"]["http_head"].startswith("GET ") and r["metadata"] is not None
        assert (r["main"]["payload"] is None) == (r["main"]["type"] == "revisit")


def test_captures(spark):
    rows = {r["page_id"]: tuple(r)[1:] for r in page_captures(spark, spark.createDataFrame(ROWS, PAGES)).collect()}
    assert rows[None][2] == "response" and rows[1][2] == rows[2][2] == "revisit" and rows[1][3] is None
    assert rows[4] == (0, digest(b""), "response", None) and rows[5] == (0, digest(b""), "revisit", 4)
    assert rows[6][0] == 100_000 and rows[3][2] == "response"
    least = {r["page_id"]: r["record_type"] for r in page_captures(spark, spark.createDataFrame(ROWS, PAGES), least=5).collect()}
    assert set(least.values()) == {"response"}
    assert page_captures(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_every_row_comes_back(spark):
    """Repeated rows, and rows without an id that differ in their url only."""
    rows = [(1, "u", "x", "r")] * 3 + [(None, "a", None, "r"), (None, "b", None, "r"), (None, None, None, "r"), (None, None, None, "r"),
                                       (2, "u", "x", "r"), (2, "v", "x", "r")]
    got = page_captures(spark, spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    found = sorted(((r["page_id"] is not None, r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in got)
    assert found == [((False, 0), "response", None)] * 4 + [((True, 1), "response", None)] * 3 + [((True, 2), "revisit", 1)] * 2


def test_members_and_plain_files():
    block = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for content in (block * 3, gzip.compress(block) + gzip.compress(block * 2)):
        assert [b for _, b in parse(content)] == [b"abc"] * 3
