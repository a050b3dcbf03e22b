"""WARC archives without repeated payloads: equal payloads are kept once, the other records are revisits of it.

Headers (id, address, digest, length) are shuffled by payload digest, not the payloads. The first page of a digest
is the response; pages join what their digest was resolved to, and records are written with fresh headers. Spark's
own text writer and binary reader move the bytes, so archives lie wherever Spark can write; a file holds at most
``records_per_file`` records, and reading it back takes one task, by the lengths its headers state.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudspark.session import scratch_path

# The format's version, line end, record end, date of records without one, and revisit profile.
VERSION = "WARC/1.1"
EOL, RECORD_END = "\r\n", "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HEX_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 2_000


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: hexadecimal digits in groups of 60, 60 and 40 bits, each rewritten as base-32 digits."""
    digest = F.sha1(data.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, start, width), 16, 32), width * 4 // 5, "0") for start, width in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), HEX_DIGITS, BASE32)


def record_id(page_id: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), copy.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload, digest, record type and the page a revisit refers to.

    Payloads of ``least_bytes`` or more that are equal (same digest and length) share one response, that of the
    smallest page_id (null last), then address; among rows alike in all of these, one is the response. Null html is an empty
    payload; columns beyond page_id, url and html are not used.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        "page_id", F.coalesce(F.regexp_replace(F.col("url").cast("string"), r"\s+", "%20"), F.lit("")).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"),
    )
    rows = rows.withColumn("key", F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "url", "payload_digest"))
    headers = rows.filter(F.col("payload_bytes") >= least_bytes).select("key", "payload_digest", "payload_bytes").distinct()
    first = headers.groupBy("payload_digest", "payload_bytes").agg(F.min("key").alias("first"))
    verdict = headers.join(first, ["payload_digest", "payload_bytes"]).select("key", "first")
    copies = Window.partitionBy("key").orderBy("payload_bytes")
    joined = rows.join(verdict, "key", "left").withColumn("copy", F.row_number().over(copies) - 1)
    revisit = F.col("first").isNotNull() & ((F.col("first") != F.col("key")) | (F.col("copy") > 0))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", "copy",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_url"),
    )


def record_text(rows: DataFrame) -> Column:
    """A record without its end: header lines, a blank line, and the block (an HTTP head and the payload, or nothing for a revisit)."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("copy"))), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.lit(0)))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("refers_to_url"))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("payload_bytes") + len(HTTP_HEAD))),
    ]
    return F.concat(F.concat_ws(EOL, *lines), F.lit(RECORD_END), F.when(revisit, "").otherwise(F.concat(F.lit(HTTP_HEAD), F.col("payload"))))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes the deduplicated records as gzip-compressed archives below ``path``."""
    rows = resolved(pages, least_bytes)
    out = rows.select(record_text(rows).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip")
    out.option("maxRecordsPerFile", records_per_file).text(path)


HEADER = re.compile(rb"([A-Za-z-]+): (.*)")


def records(data: bytes):
    """(headers, start and end of the block) of each record, by the lengths that the headers state."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].split(b"\r\n")
        if version != VERSION.encode():
            raise ValueError(f"no record starts at byte {at}")
        headers = {m[1].decode(): m[2].decode() for m in map(HEADER.fullmatch, lines) if m}
        end = stop + 4 + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not as long as it says")
        yield headers, stop + 4, end
        at = end + 4


def read_archives(spark: SparkSession, path: str, page_id: str = "long", with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``; the digest of each stored payload is checked on the way."""
    def parse(batches):
        import base64
        import hashlib

        for batch in batches:
            for data in batch["content"]:
                out = []
                for h, start, end in records(raw := gzip.decompress(data.as_py())):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = h["WARC-Type"] == "revisit"
                    payload = None if revisit else raw[start:end].partition(b"\r\n\r\n")[2]
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"damaged payload of {h['WARC-Record-ID']}")
                    out.append((h.get("X-Page-ID"), int(h["X-Payload-Length"]), digest, h["WARC-Type"], h.get("X-Refers-To-Page-ID"), h["WARC-Target-URI"], payload if with_payload else None))
                for cut in range(0, len(out), 500):
                    columns = zip(*out[cut : cut + 500], strict=True)
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    out = files.mapInArrow(parse, ", ".join(f"{n} {k}" for n, k in zip(NAMES, ("string", "long", "string", "string", "string", "string", "binary"), strict=True)))
    out = out.withColumn("page_id", F.col("page_id").cast(page_id)).withColumn("refers_to", F.col("refers_to").cast(page_id))
    return out if with_payload else out.drop("payload")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]


def archive(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives (to a new folder of the shared one, unless ``path`` says else) and returns what they hold.

    An empty table gives an empty archive and no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
