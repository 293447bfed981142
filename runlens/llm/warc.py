"""Operator 10: WARC archives with revisit records for repeated payloads.

Headers (page_id, payload digest, length, second hash) are cut from the pages first and shuffled by
digest, after a partial aggregation, so a payload that a third of all pages share is one
row a task. Of records with equal payloads of at least ``min_bytes`` bytes the one with
the largest page_id is the response; the join of the rest to it gives their
WARC-Refers-To. Payloads move once, to the archives.

A record is a string, and the record separator is the line separator of Spark's text
writer, so archives are valid WARC/1.1 files written by Spark's own committer on any file
system, compressed by gzip. Archives hold about ``ARCHIVE_BYTES`` of records each. They are
read back as whole files and parsed by Content-Length; digests of responses are recomputed and must agree.

Defined cases: null html is an empty payload; null url gives no WARC-Target-URI, control
characters and spaces in a url are percent-encoded; a null page_id is record "null",
smaller than all others; rows repeated with the same page_id and payload are one capture
and get the same record type each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, session, work_path, written

ARCHIVE_BYTES = 16 << 20
SEPARATOR = "\r\n\r\n"
#: Date of the fresh headers; a constant, so that reruns agree.
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Upper-case base32 SHA-1 of a column, 20 bits (5 hex digits, 4 letters) at a time."""
    hex_ = F.sha1(payload)

    def four(k):
        bits = F.conv(F.substring(hex_, 5 * k + 1, 5), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.concat(*(four(k) for k in range(8)))


def captures(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), F.xxhash64(payload).alias("check"))


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``headers`` (page_id, digest, bytes) with refers_to: the response of a revisit, null for responses.

    Payloads are equal if digest, length and a second hash are. The largest page_id of
    equal ones is the response; null, the least, is one only where all are null.
    """
    whole = headers.where(F.col("bytes") >= min_bytes)
    groups = whole.groupBy("digest", "bytes", "check").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = headers.join(groups, ["digest", "bytes", "check"], "left")
    revisit = (F.col("bytes") >= min_bytes) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return both.select("page_id", "digest", "bytes", "check", F.when(revisit, F.col("response")).alias("refers_to"))


def record(page_id, url, html, digest, bytes_, refers_to):
    """The text of one WARC record without its closing separator."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    urn = lambda x: F.concat(F.lit("<urn:runlens:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))
    safe = url
    for code in (*range(0x21), 0x7F):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), bytes_.cast("string"), F.lit("\r\n\r\n"))
    again = refers_to.isNotNull()
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(bytes_)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(page_id)),
        line("WARC-Date", F.lit(WARC_DATE)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(again, F.concat(line("WARC-Refers-To", urn(refers_to)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, http, F.when(again, F.lit("")).otherwise(F.coalesce(html, F.lit(""))))


def write_archives(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Write deduplicated archives; returns their folder."""
    spark = session(pages)
    path = path or work_path(spark, "warc")
    rows = captures(pages)
    headers = written(rows.select("page_id", "digest", "bytes", "check"), "headers")
    total = headers.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    resolved = resolve(headers, min_bytes).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("check").alias("_check"), "refers_to").distinct()
    width = max(1, math.ceil((total.s + 600 * total.n) / ARCHIVE_BYTES))
    # Joined by page, not by payload: pages are many and distinct, so no key is hot.
    joined = rows.join(resolved, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")) & (F.col("check") == F.col("_check")))
    text = joined.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html"), F.col("digest"), F.col("bytes"), F.col("refers_to")).alias("value"))
    text.select("value").write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", max(1, math.ceil(total.n / width))).text(path)
    forget(headers)
    return path


def parse(data: bytes):
    """Records of one archive, plain or gzip: (headers by lower-case name, block)."""
    data, at = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at += 4


def _page(urn: str | None):
    return None if urn is None or urn.endswith(":null>") else int(urn[1:-1].rpartition(":")[2])


def _records(batches):
    for batch in batches:
        rows = []
        for data in batch.column(0):
            for fields, block in parse(data.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                n = int(http.rpartition(b"Content-Length: ")[2])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                rows.append((_page(fields["warc-record-id"]), n, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields.get("warc-target-uri")))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")
