"""WARC archives: pages are written as transactions, read back, and assembled to captures.

Writing.  Each page gives three records: the request, the response (or a revisit,
where its payload is written by another page) and metadata with the page's id.
Request and metadata name the response or revisit in WARC-Concurrent-To.  Of pages
with equal payloads of at least `least` bytes the one with the largest id is the
response; the others are revisits that refer to it and carry its digest, not its
bytes.  A row of a table of strings with CRLF CRLF as the line separator is an
archive's text, so Spark's own writer and its commit protocol do the writing, into
gzip files of at most `FILE_PAGES` pages each.

Reading.  gzip files are never split, so a task streams a file's pieces between
CRLF CRLF in order; pieces are joined again and cut by Content-Length, so payloads
may hold any bytes, separators and whole records too.  Block and payload digests
are recomputed; a record whose digest differs, or that ends early, is an error.

Assembly.  Responses and revisits are joined with the requests and the metadata
whose WARC-Concurrent-To names them, or which they name; revisits are joined with
the responses that they refer to.  One nested row for each capture.

Nulls: a null payload is empty; a null url leaves out its headers; a null page id
is smaller than any and stays null.  Repeated rows with the same page id and payload
write records with the same id, which reading takes as one; rows of one page id
with other payloads are captures of their own, each of them the response if the id
is the largest of its payload.  Several requests or metadata records of one capture:
the one with the smallest id is taken, all are counted.  Payloads of any length are
one value of a row.  Empty tables write empty archives, which give no rows.  Only
the named columns are read, so others may clash.

Scale: payloads are digested where they are read; pages meet the largest ids of
payloads that occur again in a join that broadcasts that table while it is small
and else splits hot digests.  `page_captures` reads the archives once, into a table
of records without payloads, and only such narrow rows are shuffled.  Archives stay
in the shared folder until `shared.clear`.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

SEPARATOR = "\r\n\r\n"
#: Pages in one archive at most.
FILE_PAGES = 20_000
#: The digits of base 32 in this format, and the revisit profile.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 40 hex digits in eight groups of 20 bits, each four digits of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", DIGITS)


def _record_id(kind: str, page_id: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines, those with a null value left out; no value can begin a line of its own."""
    return F.concat_ws("\r\n", *(F.concat(F.lit(name + ": "), F.regexp_replace(value, r"[\r\n]+", " ")) for name, value in pairs))


def _record(kind: Column, record_id: Column, block: Column, *more: tuple[str, Column]) -> Column:
    size = F.octet_length(block).cast("string")
    sha1 = F.concat(F.lit("sha1:"), base32_sha1(block.cast("binary")))
    return F.concat(F.lit("WARC/1.1\r\n"), _lines(("WARC-Type", kind), ("WARC-Record-ID", record_id), *more, ("WARC-Block-Digest", sha1), ("Content-Length", size)), F.lit(SEPARATOR), block)


def write_archives(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """The folder of the archives, in the shared folder."""
    # A string's bytes are its UTF-8; a binary payload becomes a string of the same bytes.
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select(F.col("digest").alias("held"), "last_id"), "payloads")
    rows = rows.join(groups, F.col("digest") == F.col("held"), "left")
    revisits = F.col("held").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    of = _record_id("capture", F.col("page_id"), F.col("digest"))
    first = _record_id("capture", F.col("last_id"), F.col("digest"))
    uri, sha1, when = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Date", F.lit(date))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.col("url"), "^[a-z]+://[^/?#]*|#.*$", ""), r"[\s]", "%20")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))))
    asked = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\n"), _lines(("Host", host)), F.lit(SEPARATOR))
    size = F.octet_length("payload").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", size)), F.lit(SEPARATOR))
    answer = F.when(revisits, head).otherwise(F.concat(head, F.col("payload")))
    about = F.concat(_lines(("page-id", F.col("page_id").cast("string")), ("payload-bytes", size)), F.lit("\r\n"))
    capture = _record(
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")), of, answer, when, uri, sha1,
        ("WARC-Profile", F.when(revisits, F.lit(PROFILE))), ("WARC-Refers-To", F.when(revisits, first)), ("Content-Type", F.lit("application/http; msgtype=response")),
    )
    request = _record(F.lit("request"), _record_id("request", F.col("page_id"), F.col("digest")), asked, when, uri, ("WARC-Concurrent-To", of), ("Content-Type", F.lit("application/http; msgtype=request")))
    metadata = _record(F.lit("metadata"), _record_id("metadata", F.col("page_id"), F.col("digest")), about, when, uri, ("WARC-Concurrent-To", of), ("Content-Type", F.lit("application/warc-fields")))
    folder = new_path(pages.sparkSession, "archives")
    text = rows.select(F.concat_ws(SEPARATOR, request, capture, metadata).alias("value"))
    text.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", FILE_PAGES).text(folder)
    return folder


_FIELDS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "content_type": "content-type", "stated_digest": "warc-payload-digest",
}
_RECORD = pa.schema([(n, pa.string()) for n in _FIELDS] + [("concurrent_to", pa.list_(pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
_RECORD_DDL = ", ".join(f"{n} string" for n in _FIELDS) + ", concurrent_to array<string>, payload binary, payload_bytes long, payload_digest string, fields map<string, string>"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(block: bytes) -> list[tuple[str, str]]:
    """(lower-case name, value) of each line behind the first."""
    pairs = (line.partition(b":") for line in block.split(b"\r\n")[1:])
    return [(a.decode("utf-8", "replace").strip().lower(), b.decode("utf-8", "replace").strip()) for a, _, b in pairs]


def _parsed(head: bytes, block: bytes) -> dict:
    """A record as a row; its digests are checked."""
    pairs = _headers(head)
    held = dict(pairs)
    row = {name: held.get(h) for name, h in _FIELDS.items()} | {"concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"], "fields": None}
    payload = block
    if (row["content_type"] or "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif row["content_type"] == "application/warc-fields":
        row["fields"] = _headers(b"\r\n" + block.strip())
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        stated = held.get(name, "")
        if stated.lower().startswith("sha1:") and not (name == "warc-payload-digest" and row["record_type"] == "revisit") and stated[5:].upper() != digest_of(data):
            raise ValueError(f"{row['record_id']}: {name} is {stated}, the bytes have {digest_of(data)}")
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest_of(payload)}


def _records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[dict]:
    """Records from a file's pieces between separators, one file behind the other."""
    file, head, need, held = None, None, 0, bytearray()
    for name, piece in pieces:
        if name != file:
            if head is not None:
                raise ValueError(f"{file} ends within a record")
            file = name
        if head is None:
            # What stands between records is separators, so empty pieces.
            start = piece.lstrip(b"\r\n")
            if not start:
                continue
            if not start.startswith(b"WARC/"):
                raise ValueError(f"{file}: no record begins with {start[:40]!r}")
            head, need, held = start, int(dict(_headers(start))["content-length"]), bytearray()
            continue
        held += piece
        if len(held) < need:
            held += SEPARATOR.encode()
            if len(held) < need:
                continue
        yield _parsed(head, bytes(held[:need]))
        rest, head = bytes(held[need:]).strip(b"\r\n"), None
        if rest:
            raise ValueError(f"{file}: a block is longer than its Content-Length")
    if head is not None:
        if len(held) < need:
            raise ValueError(f"{file} ends within a record")
        yield _parsed(head, bytes(held[:need]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    rows, size = [], 0
    for row in _records(pieces()):
        rows.append(row)
        size += row["payload_bytes"] + 500
        if size > 1 << 22:
            yield pa.RecordBatch.from_pylist(rows, _RECORD)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip archives: a folder, a file or a pattern; any writer's, one or many gzip members."""
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(_read, _RECORD_DDL)


_CAPTURES = ("response", "revisit", "resource", "conversion")


def captures(records: DataFrame, payload: bool = True) -> DataFrame:
    """One row for each response, revisit or other capture: capture_id, capture, request, metadata, n_requests, n_metadata, original, payload.

    The structs hold the record's columns but for the payload; `original` is the response a revisit refers to.  The payload
    is the capture's, left out if not asked for.  The records are read several times, so they had better be a table than archives.
    """
    narrow = records.drop("payload")
    whole = F.struct(*narrow.columns)
    primary = F.col("record_type").isin(*_CAPTURES)
    out = narrow.where(primary).groupBy(F.col("record_id").alias("capture_id")).agg(F.any_value(whole).alias("capture"))
    # A capture may also name its request or metadata itself.
    named = narrow.where(primary).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("other_id"))
    for kind, column, count in (("request", "request", "n_requests"), ("metadata", "metadata", "n_metadata")):
        own = narrow.where(F.col("record_type") == kind)
        by_them = own.select(F.explode("concurrent_to").alias("of_id"), "record_id", whole.alias("whole"))
        by_us = own.select("record_id", whole.alias("whole")).join(named, F.col("record_id") == F.col("other_id")).select(F.col("capture_id").alias("of_id"), "record_id", "whole")
        side = by_them.unionByName(by_us).groupBy("of_id", "record_id").agg(F.any_value("whole").alias("whole"))
        side = side.groupBy("of_id").agg(F.min_by("whole", "record_id").alias(column), F.count("*").alias(count))
        out = out.join(side, F.col("capture_id") == F.col("of_id"), "left").drop("of_id").withColumn(count, F.coalesce(count, F.lit(0)))
    # From a table both sides of the next join are plain shuffles, which adaptive execution can split.
    out = written(out, "captures")
    originals = out.where("capture.record_type = 'response'").select(F.col("capture_id").alias("original_id"), F.struct("capture.payload_bytes", "capture.payload_digest", "capture.target_uri", "metadata.fields").alias("original"))
    refers = F.col("capture.refers_to")
    # What refers to nothing meets itself, so that nulls don't meet in one task.
    out = out.join(originals, F.coalesce(refers, "capture_id") == F.col("original_id"), "left").withColumn("original", F.when(refers.isNotNull(), F.col("original"))).drop("original_id")
    if not payload:
        return out
    held = records.where(primary).groupBy(F.col("record_id").alias("of_id")).agg(F.any_value("payload").alias("payload"))
    return out.join(held, F.col("capture_id") == F.col("of_id"), "left").drop("of_id")


def page_captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from archives that are written and read back."""
    kind = pages.schema["page_id"].dataType
    records = read_records(pages.sparkSession, write_archives(pages, least)).drop("payload")
    rows = captures(written(records, "records"), payload=False)
    full = F.when(F.col("capture.record_type") == "revisit", F.col("original")).otherwise(F.struct("capture.payload_bytes", "capture.payload_digest", "capture.target_uri", "metadata.fields"))
    return rows.select(
        F.col("metadata.fields")["page-id"].cast(kind).alias("page_id"), full["payload_bytes"].alias("payload_bytes"), full["payload_digest"].alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"), F.col("original.fields")["page-id"].cast(kind).alias("refers_to"),
    )
