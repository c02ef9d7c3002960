"""WARC: archives of captures, and the assembly of captures from their records.

Writing: every page becomes a response (or revisit), a request and a metadata record, built as one string each by column
expressions and written by Spark's text writer with the record's closing CRLF CRLF as its line separator. So the
committer of the file system in use handles lost tasks, on any store that Spark writes to. Files are gzip, of at most
``RECORDS_PER_FILE`` records each. Payloads that are equal (by SHA-1, as WARC has it) are stored once: the capture with
the smallest page_id is the response, all others are revisits that refer to it.

Reading: each archive is parsed as a stream by its Content-Length fields; request and metadata records are joined with
their response through WARC-Concurrent-To, giving one nested row per capture. A revisit's payload is that of the
response it refers to.

Defined results: a null html is an empty payload; a null url is written without a target; CR and LF in a url are
percent-encoded; a null page_id comes last among equal payloads; rows equal in page_id, url and html are one capture
and come back as often as they were written; an empty table gives an empty table; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm.common import arrow_rows, scratch_path, table, written

RECORDS_PER_FILE = 9000
#: Payloads of fewer bytes are always stored in full.
LEAST_BYTES = 0
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, page_id bigint, payload_bytes bigint, payload_digest string, payload binary"


def base32(hex40: Column) -> Column:
    """The base32 form of 160 bits in hex: each 5 hex digits are 4 characters."""

    def character(i: Column) -> Column:
        bits = F.conv(F.substring(hex40, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
        return F.substring(F.lit(BASE32), F.call_function("shiftright", bits, (5 * (3 - i % 4)).cast("int")).bitwiseAND(31) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), character), "")


def urn(kind: str, *parts: Column) -> Column:
    """A record id from what identifies the record."""
    digest = F.md5(F.concat_ws("\n", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts)))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def record(kind: str | Column, record_id: Column, content_type: str, block: Column, fields: dict[str, Column]) -> Column:
    """A record without its closing CRLF CRLF. Fields that are null are left out."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    head += [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    head += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write page_id, url, html as WARC files below ``path``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url")).alias("first")
    large = F.octet_length("html") >= least_bytes
    groups = rows.filter(large).groupBy("sha1").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = rows.join(groups, "sha1", "left")
    revisit = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    capture = urn("response", F.col("page_id"), F.col("url"), F.col("sha1"))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    target = F.regexp_extract(F.coalesce(uri, F.lit("")), r"(?s)^.*?://([^/?#]*)(.*)$", 2)
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    original = urn("response", F.col("first.page_id"), F.col("first.url"), F.col("sha1"))
    records = F.array(
        record(
            F.when(revisit, "revisit").otherwise("response"),
            capture,
            "application/http;msgtype=response",
            F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
            {"WARC-Target-URI": uri, "WARC-Payload-Digest": digest, "WARC-Profile": F.when(revisit, PROFILE), "WARC-Refers-To": F.when(revisit, original)},
        ),
        record("request", urn("request", F.col("page_id"), F.col("url"), F.col("sha1")), "application/http;msgtype=request", request, {"WARC-Target-URI": uri, "WARC-Concurrent-To": capture}),
        record("metadata", urn("metadata", F.col("page_id"), F.col("url"), F.col("sha1")), "application/warc-fields", about, {"WARC-Target-URI": uri, "WARC-Concurrent-To": capture}),
    )
    lines = found.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields and the block of every record of one archive, plain or gzip."""
    stream = io.BytesIO(content)
    archive = gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream
    while line := archive.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := archive.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = archive.read(length)
        if len(block) != length:
            raise ValueError(f"a record ends after {len(block)} of {length} bytes")
        yield fields, block


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; payloads are measured, and kept only ``with_payload``."""
    schema = pa.schema([(n, t) for n, t in zip([x.split()[0] for x in RECORD.split(", ")], [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string(), pa.binary()], strict=True)])

    def rows_of(content: bytes) -> Iterator[tuple]:
        for fields, block in parse_archive(content):
            kind, page_id, payload = fields.get("warc-type"), None, None
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
            elif kind == "metadata":
                for line in block.split(b"\r\n"):
                    if line.startswith(b"page-id:"):
                        page_id = int(line[8:])
            size = None if payload is None else len(payload)
            digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest and fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                raise ValueError(f"{fields.get('warc-record-id')}: the payload does not match its digest")
            yield fields.get("warc-record-id"), kind, fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), page_id, size, digest, payload if with_payload else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows_of(content.as_py()):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(each, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, n (times it was written), response, request, metadata.

    Records meet through WARC-Concurrent-To. A capture that lacks a record has null in its place.
    """
    of_response = F.col("type").isin("response", "revisit")
    keyed = records.withColumn("capture_id", F.when(of_response, F.col("record_id")).otherwise(F.col("concurrent_to"))).filter("capture_id IS NOT NULL")
    main = F.struct("type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload")
    only = lambda test, value, name: F.first(F.when(test, value), ignorenulls=True).alias(name)
    return keyed.groupBy("capture_id").agg(
        F.count_if(of_response).alias("n"),
        only(of_response, main, "response"),
        only(F.col("type") == "request", F.struct("record_id", "target_uri"), "request"),
        only(F.col("type") == "metadata", F.struct("record_id", "page_id"), "metadata"),
    )


def resolved(found: DataFrame) -> DataFrame:
    """Captures whose revisits carry the payload of the response that they refer to, and its page_id."""
    originals = found.filter("response.type = 'response'").select(F.col("capture_id").alias("original"), F.col("response").alias("full"), F.col("metadata.page_id").alias("original_page"))
    revisits = found.filter("response.type = 'revisit'").join(originals, F.col("response.refers_to") == F.col("original"))
    full = F.struct(F.lit("revisit").alias("type"), "response.refers_to", "response.target_uri", "full.payload_bytes", "full.payload_digest", "full.payload")
    joined = revisits.select("capture_id", "n", full.alias("response"), "request", "metadata", F.col("original_page").alias("refers_to_page"))
    return found.filter("response.type = 'response'").withColumn("refers_to_page", F.lit(None).cast("bigint")).unionByName(joined)


def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into archives, read them back and assemble the captures: one row per page."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    with arrow_rows(spark, 1):  # archives are large rows
        records = written(read_records(spark, path, with_payload=False), "warc-records")  # parsed once
    found = resolved(captures(records))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)
"""
