"""WARC archives: written through Spark's file writers, read back, and assembled into captures.

Each capture is three records of WARC/1.1: the response (or, where an equal
payload is archived already, a revisit), the request and a metadata record. The
latter two name the first in WARC-Concurrent-To. Reading parses every archive
record by record from its Content-Length, joins the three through these names
and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrill.session import fresh_path, materialize

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "payload_digest string, http_head string, fields map<string,string>, payload_bytes long, payload_ok boolean, "
          "payload binary")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(kind: str, page_id, url: str | None, payload_digest: str, copy: int) -> str:
    """The same name for the same record in every attempt of a task; equal rows are told apart by `copy`."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}|{page_id}|{payload_digest}|{copy}|{'' if url is None else '=' + url}").urn


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block


def _transaction(page_id, url, payload: bytes, first, first_url, copy: int, date: str, least: int) -> list[bytes]:
    """The three records of one page, each without the two line ends that close it."""
    sha, uri = digest(payload), (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    revisit = len(payload) >= least and first != page_id
    name = record_name("capture", page_id, url, sha, copy)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    same = [("WARC-Target-URI", f"<{uri}>"), ("WARC-Date", date)]
    main = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{name}>"), *same,
            ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        main += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{record_name('capture', first, first_url, sha, 1)}>")]
    path = re.sub(r"^[a-z]+://[^/]*", "", uri) or "/"
    request = f"GET {path} HTTP/1.1\r\nAccept: text/html\r\n\r\n".encode("utf-8", "surrogatepass")
    fields = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    to = [("WARC-Concurrent-To", f"<{name}>")]
    return [
        _record(main, http if revisit else http + payload),
        _record([("WARC-Type", "request"), ("WARC-Record-ID", f"<{record_name('request', page_id, url, sha, copy)}>"), *same, *to,
                 ("Content-Type", "application/http; msgtype=request")], request),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<{record_name('metadata', page_id, url, sha, copy)}>"), *same, *to,
                 ("Content-Type", "application/warc-fields")], fields)]


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z",
                   archive_records: int = 6000) -> None:
    """Writes gzip archives below `path`, of at most `archive_records` records each.

    `pages` has page_id, url and html. A null html is an empty payload, a null
    url becomes urn:page:<page_id>. Of rows with equal payloads of at least
    `least` bytes, those with the smallest page_id are responses, the others
    revisits that name it. Every row gives its records, also one that another
    repeats. A null page_id sorts before all others. An empty table writes no record.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("sha", F.sha2("payload", 256))
    light = pages.groupBy("sha", "page_id", "url").agg(F.count("*").alias("copies"))
    # a null page_id is the smallest of its group, and so is a null url
    ordered = F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", F.col("url").isNotNull().alias("placed"), "url")
    first = light.groupBy("sha").agg(F.min(ordered).alias("least"), F.sum("copies").alias("n")).where("n > 1").select(
        "sha", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"), F.lit(True).alias("shared"))
    again = materialize(light.where("copies > 1"), "warc_repeated")
    once = pages.withColumn("copies", F.lit(1).cast("long"))
    if again.limit(1).count():  # rows that repeat others are written from one of them
        same = [pages[c].eqNullSafe(again[c]) for c in ("sha", "page_id", "url")]
        once = pages.join(again, same, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(
            pages.join(again, same).select(*[pages[c] for c in pages.columns], "copies").dropDuplicates(["sha", "page_id", "url"]))
    shared = F.col("shared")
    rows = once.join(first, "sha", "left").select(
        "page_id", "url", "payload", F.when(shared, F.col("first")).otherwise(F.col("page_id")).alias("first"),
        F.when(shared, F.col("first_url")).otherwise(F.col("url")).alias("first_url"), "copies")

    def run(batches):
        for batch in batches:
            lines, size = [], 0
            for row in zip(*(batch.column(i) for i in range(6))):
                page_id, url, payload, one, one_url, copies = (x.as_py() for x in row)
                for copy in range(1, copies + 1):
                    lines += _transaction(page_id, url, payload, one, one_url, copy, date, least)
                    size += len(payload)
                if size > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["value"])
                    lines, size = [], 0
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["value"])

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # the separator of lines is what closes a record, so the text files are archives
    (lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", archive_records).text(path))


def _chunks(content: bytes, size: int = 1 << 20):
    """The archive's bytes; gzip members one after another, or plain."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        data = member.decompress(content, size)
        while data or not member.eof:
            yield data
            if member.eof:
                break
            data = member.decompress(member.unconsumed_tail, size)
            if not data and not member.unconsumed_tail and not member.eof:
                raise ValueError("truncated archive")
        content = member.unused_data


def parse(content: bytes):
    """(headers with lower-case names, block) for every record; a broken record raises ValueError."""
    chunks, held = _chunks(content), b""

    def more() -> bool:
        nonlocal held
        data = next(chunks, None)
        held += data or b""
        return data is not None

    while True:
        while b"\r\n\r\n" not in held and more():
            pass
        if not held.strip():
            return
        end = held.find(b"\r\n\r\n")
        if end < 0 or not held.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head)}
        need = end + 4 + int(headers["content-length"])
        parts, size = [held], len(held)
        while size < need + 4:
            data = next(chunks, None)
            if data is None:
                break
            parts.append(data)
            size += len(data)
        held = b"".join(parts)
        if len(held) < need:
            raise ValueError("truncated record")
        yield headers, held[end + 4:need]
        if held[need:need + 4] not in (b"\r\n\r\n", b""):
            raise ValueError("record not closed")
        held = held[need + 4:]


def _pairs(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, s, v in
            (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")) if s}


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below `path`, with the columns of RECORD.

    payload_bytes is the size of the full payload: of the block's body for
    responses, as the archived HTTP head states it for revisits. payload_ok
    says whether the payload has the digest its header states (null: no
    payload). Without `payloads` the payload itself is left out (null).
    """
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 8 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.bool_(), pa.binary()]

    def bare(value):
        return value[1:-1] if value and value.startswith("<") else value

    def row(h, block):
        kind = h.get("warc-type")
        head, body, fields, size, ok = None, None, {}, None, None
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if "application/http" in h.get("content-type", ""):
            top, _, body = block.partition(b"\r\n\r\n")
            head = top.decode("utf-8", "replace")
            if kind == "response":
                size, ok = len(body), digest(body) == stated
            elif kind == "revisit":
                size, body = int(_pairs(top).get("content-length", 0)), None
            else:
                body = None
        elif kind == "metadata":
            fields = _pairs(block)
        return (bare(h.get("warc-record-id")), kind, bare(h.get("warc-concurrent-to")), bare(h.get("warc-refers-to")),
                bare(h.get("warc-target-uri")), h.get("warc-date"), stated, head, list(fields.items()), size, ok,
                body if payloads else None)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_buffer().to_pybytes()):
                    rows.append(row(h, block))
                    size += len(block)
                    if size > 1 << 22 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, main, request, metadata (structs of record columns).

    Records that name no other in concurrent_to are captures if they are
    responses or revisits; requests and metadata records join the capture they
    name. Of several of one kind that with the smallest record_id is taken;
    repeated records count once; a capture may lack either. Records that name
    a capture that is not there are left out, as are those without a name.
    """
    def kind(name, *kinds):
        struct = F.struct("record_id", "target_uri", "date", "type", "refers_to", "payload_digest", "http_head",
                          F.map_entries("fields").alias("fields"), "payload_bytes", "payload_ok", "payload")
        return F.min(F.when(F.col("type").isin(*kinds), struct)).alias(name)

    return (records.withColumn("capture_id", F.when(F.col("type").isin("response", "revisit"), F.col("record_id"))
                               .otherwise(F.col("concurrent_to")))
            .where("capture_id IS NOT NULL").groupBy("capture_id")
            .agg(kind("main", "response", "revisit"), kind("request", "request"), kind("metadata", "metadata"))
            .where("main IS NOT NULL"))


def page_captures(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes `pages` as archives in the shared folder, reads them back: a row per row, with the page that its record names."""
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least)
    captures = materialize(assemble(read_records(spark, path, payloads=False)).select(
        "capture_id", F.expr("try_cast(map_from_entries(metadata.fields)['page-id'] AS bigint)").alias("page_id"),
        F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("names")), "captures")
    # revisits alone are joined, to the response that each names; those of a hot payload are split by AQE
    named = captures.where("record_type = 'response'").select(F.col("capture_id").alias("names"), F.col("page_id").alias("refers_to"))
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = captures.where("record_type = 'revisit'").join(named, "names", "left").select(*kept)
    return captures.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*kept).union(revisits)
