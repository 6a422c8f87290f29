"""WARC archives without repeated payloads.

Headers alone (page id, payload digest and length) are shuffled by digest; of
the pages that share a payload the one with the least id becomes a ``response``
record, the others ``revisit`` records that refer to it and carry the HTTP
header but no payload. Reading resolves revisits by joining them to the
responses they refer to.

Archives are written by Spark's text writer: a record is a string and the line
separator is the CRLF CRLF that ends every WARC record, so the files are plain
WARC/1.1, gzipped as a whole. Gzipped files aren't split, so one task reads a
file from its begin and cuts records by their Content-Length, a few chunks in
memory at a time, whatever the payloads contain.

Defined cases: a null html is the empty payload, and equal empty payloads
revisit each other like any others (``min_bytes`` 0); rows that repeat both the
page id and the payload of a response are responses too; null page ids are
never referred to (a payload that only such rows hold is a response each time);
line breaks in urls are percent-encoded; no rows give an empty archive. Payloads are
written whole; of equal payloads the smallest page id is the response. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitnet.llm.common import map_batches, stored

RECORD_END = "\r\n\r\n"
#: Pages carry no crawl time; archives state this one unless the caller gives another.
DATE = "1970-01-01T00:00:00Z"
RECORDS_PER_FILE = 20_000
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five bytes, ten hex digits, are eight base-32 digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def described(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    return pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )


def originals(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(payload_digest, first_id)`` of every payload that more than one row holds."""
    repeated = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    return repeated.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first_id")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def record_text(date: str = DATE) -> Column:
    """A record from the columns of ``described`` and ``refers_to`` (null: a response)."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("refers_to")), F.lit("\r\n")
    )
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(RECORD_END),
        block,
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row below ``path``."""
    own = described(pages, page_id, url, html)
    first = stored(originals(own.select("page_id", "payload_bytes", "payload_digest"), min_bytes), "warc-originals")
    kept = F.col("first_id").isNull() | F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    decided = own.join(first, "payload_digest", "left").withColumn("refers_to", F.when(~kept, F.col("first_id")))
    text = decided.select(record_text(date).alias("value"))
    text.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)


def _number(urn: bytes | None) -> int | None:
    digits = (urn or b"")[len(b"<urn:page:") : -1]
    return None if digits in (b"", b"null") else int(digits)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes, bytes]]:
    """The records of a stream that comes in chunks: header fields, HTTP header and payload."""
    end = RECORD_END.encode()
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            begin = held.find(b"WARC/")
            stop = held.find(end, begin) if begin >= 0 else -1
            if stop < 0:
                need = len(held) + 1
                break
            fields = _fields(bytes(held[begin:stop]))
            need = stop + 4 + int(fields[b"Content-Length"]) + 4
            if len(held) < need:
                break
            block = bytes(held[stop + 4 : need - 4])
            del held[:need]
            need = 0
            http, _, payload = block.partition(end)
            yield fields, http, payload


def _parse(payloads: bool):
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunks = ((value + RECORD_END).encode() for batch in batches for value in batch.column("value").to_pylist())
        rows: list[tuple] = []
        size = 0
        for fields, http, payload in records(chunks):
            kind = fields[b"WARC-Type"].decode()
            digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
            length = int(_fields(http)[b"Content-Length"])
            if kind == "response":
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if (found, len(payload)) != (digest, length):
                    raise ValueError(f"record {fields[b'WARC-Record-ID']!r}: the payload doesn't have its digest or length")
            row = (_number(fields[b"WARC-Record-ID"]), fields[b"WARC-Target-URI"].decode(), kind, _number(fields.get(b"WARC-Refers-To")), digest, length)
            rows.append((*row, payload.decode() if kind == "response" else None) if payloads else row)
            size += len(payload) if payloads else 0
            if len(rows) >= 1000 or size >= 8 << 20:
                yield dict(zip(names, zip(*rows)))
                rows, size = [], 0
        if rows:
            yield dict(zip(names, zip(*rows)))

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below ``path``; with ``payloads`` also their payloads (null for revisits)."""
    chunks = spark.read.schema("value string").option("lineSep", RECORD_END).text(path)
    return map_batches(chunks, _parse(payloads), RECORD_SCHEMA + ", payload string" * payloads)


def resolved(records: DataFrame) -> DataFrame:
    """Every record with the payload columns of the response that it is or refers to."""
    given = [c for c in ("payload_digest", "payload_bytes", "payload") if c in records.columns]
    responses = records.where("record_type = 'response'").where(F.col("page_id").isNotNull()).dropDuplicates(["page_id", "payload_digest"])
    originals = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", *[F.col(c).alias(f"original_{c}") for c in given if c != "payload_digest"])
    joined = records.where("record_type = 'revisit'").join(originals, ["refers_to", "payload_digest"], "left")
    names = ["page_id", "url", "record_type", "refers_to", *given]
    back = [F.col(f"original_{c}").alias(c) if c in given and c != "payload_digest" else F.col(c) for c in names]
    return records.where("record_type = 'response'").select(*names).unionByName(joined.select(*back))
