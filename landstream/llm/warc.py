"""WARC archives with revisit resolution.

Records are written through Spark's text writer: a record ends with two line ends, which is the line separator given to the
writer, so that a file is a plain sequence of WARC records (gzip-compressed as a whole), on any file system that Spark reaches,
with Spark's own commit of tasks. Reading goes through binaryFile and follows Content-Length, so payloads may hold anything.

Only headers (id, digest, length) are shuffled by payload digest: the smallest id of each digest is aggregated before the
shuffle, so a payload that a third of all pages share doesn't gather anywhere. Payloads move once, by page id, to the writer.

Cases: a null payload is an empty one; a null page_id is never an original while another page has the payload; rows that
repeat a page_id with the same payload are all responses if the id is the smallest; line ends in urls are percent-encoded;
an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table

END = "\r\n"
#: The alphabet of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds of the files, and with them of what a task reads at once: records, and bytes of payloads (or one record).
RECORDS_PER_FILE, BYTES_PER_FILE = 10_000, 1 << 30
#: Classes of payloads by size: class 0 takes all that fit a full file of records, each further one twice the size.
CLASSES = 16
#: Bytes that are decompressed at once.
CHUNK = 1 << 20


def base32_of(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits, from JVM functions only: 8 groups of 20 bits, 4 letters each."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers (page_id, payload_digest, payload_bytes) -> distinct (page_id, payload_digest) with record_type and refers_to.

    Of the records with equal payloads of at least min_bytes, that with the smallest page_id is the response and the others
    revisit it; smaller ones are all responses.
    """
    first = headers.groupBy("payload_digest").agg(F.min("page_id").alias("__first"))
    known = headers.select("page_id", "payload_digest", "payload_bytes").distinct().join(first, "payload_digest")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return known.select(
        "page_id", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__first")).alias("refers_to")
    )


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))), F.substring(h, 21, 12), F.lit(">"))


def record_text(date: str) -> Column:
    """A WARC record without its end, from page_id, url, payload, payload_digest, payload_bytes, record_type and refers_to."""
    again = F.col("record_type") == "revisit"
    body = F.when(again, F.lit("")).otherwise(F.coalesce("payload", F.lit("")))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _urn(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "payload_digest")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(again, _urn(F.col("refers_to").cast("string"), "payload_digest"))),
        _line("X-Page-ID", F.col("page_id")),
        _line("X-Refers-To-Page-ID", F.col("refers_to")),
        _line("X-Payload-Length", F.col("payload_bytes")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body)),
        F.lit(END),
        body,
    )


def size_class(payload_bytes: Column) -> Column:
    """The class of a payload's length (null: 0): class k holds lengths up to 2^k shares of a file, so long ones don't shorten other files."""
    share = BYTES_PER_FILE // RECORDS_PER_FILE
    found = F.lit(CLASSES - 1)
    for k in reversed(range(CLASSES - 1)):
        found = F.when(F.coalesce(payload_bytes, F.lit(0)) <= share << k, k).otherwise(found)
    return found


def size_classes(payload_bytes: DataFrame) -> list[int]:
    """The classes in a table of one column of lengths: CLASSES numbers at most."""
    return sorted(r[0] for r in payload_bytes.select(size_class(F.col(payload_bytes.columns[0]))).distinct().collect())


def write_archives(records: DataFrame, path: str, date: str | None = None, classes: list[int] | None = None) -> None:
    """Write records (see record_text) as gzip-compressed archives within RECORDS_PER_FILE and BYTES_PER_FILE, or one record.

    date: of the new headers, now if it isn't given. classes: those of the payloads' sizes, if known; each is a write of
    its own.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    if classes is None:
        classes = size_classes(records.select("payload_bytes"))
    for at, k in enumerate(classes or [0]):
        mine = records.where(size_class(F.col("payload_bytes")) == k) if len(classes) > 1 else records
        lines = mine.select(record_text(date).alias("value"))
        out = lines.write.mode("append" if at else "error").option("lineSep", END + END).option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, RECORDS_PER_FILE >> k)).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, some at a time."""
    while data:
        one = zlib.decompressobj(zlib.MAX_WBITS | 16)
        while not one.eof:
            made = one.decompress(data, CHUNK)
            if not made and not one.unconsumed_tail and not one.eof:
                raise ValueError("archive ends inside a member")
            data = one.unconsumed_tail
            yield made
        data = one.unused_data


def parse_archive(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a stream of bytes; one record is held at a time."""
    held, at = bytearray(), 0
    parts = iter(parts)

    def need(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            part = next(parts, None)
            if part is None:
                return False
            if at > CHUNK:
                del held[:at]
                at = 0
            held += part
        return True

    while need(1):
        searched = at
        while (stop := held.find(b"\r\n\r\n", max(at, searched - 3))) < 0:
            size = len(held) - at
            if not need(size + 1):
                raise ValueError("archive ends inside a header")
            searched = at + size
        head = held[at:stop].decode("utf-8").split(END)
        if not head[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head[1:])}
        n = int(fields["content-length"])
        at = stop + 4
        if not need(n + 4) or held[at + n : at + n + 4] != b"\r\n\r\n":
            raise ValueError("record without its end")
        yield fields, bytes(held[at : at + n])
        at += n + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    Digests of responses are computed anew from the payload that was read; one that disagrees with its header is an error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for fields, block in parse_archive(_inflated(content)):
                    kind, digest, n = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                    if kind == "response" and (base64.b32encode(hashlib.sha1(block).digest()).decode() != digest or len(block) != n):
                        raise ValueError(f"payload of record {fields['warc-record-id']} disagrees with its header")
                    ids = (int(fields[x]) if x in fields else None for x in ("x-page-id", "x-refers-to-page-id"))
                    page, refers = ids
                    out.append((page, fields.get("warc-target-uri"), kind, n, digest, refers, block if kind == "response" else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield _frame(out, columns)
                        out, held = [], 0
                if out:
                    yield _frame(out, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return files.mapInPandas(parse, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "payload_bytes", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def deduplicate_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write pages (page_id, url, payload) as deduplicated archives at path, with headers of a date (now), and read them back."""
    payload = F.coalesce("payload", F.lit(""))
    full = pages.select("page_id", "url", "payload", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    kinds = resolve_revisits(full.select("page_id", "payload_digest", "payload_bytes"), min_bytes)
    kinds = kinds.select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "record_type", "refers_to")
    records = full.join(kinds, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("payload_digest") == F.col("__digest")))
    # Headers are matched by hexadecimal digests; only records that are written need the longer way to base32.
    classes = size_classes(pages.select(F.octet_length("payload")))
    write_archives(records.withColumn("payload_digest", base32_of(F.col("payload_digest"))), path, date, classes)
    return read_archives(pages.sparkSession, path)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    back = deduplicate_pages(pages, shared_path(spark, "warc"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS original FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM firsts
"""
