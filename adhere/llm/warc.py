"""Web archives: writing WARC records, reading them back, putting captures together.

A capture is written as three records: a request, a response (or a revisit of a
response with the same payload) and a metadata record, the first and the last
pointing to the middle one by ``WARC-Concurrent-To``. Spark's own text writer
and binary reader move the bytes, so archives may lie in any store Spark reaches;
several files hold the records in any order, and a capture's records may lie in
different files. Assembly joins them by their ids.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import work_path
from .common import stored, table

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Digits of Spark's number conversion in base 32.
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Payloads of fewer bytes are written again instead of revisited.
MIN_REVISIT_BYTES = 0
#: Bytes of payload of one file, about: as many captures as have so many on average. A file is read as a whole.
FILE_BYTES = 64 << 20
#: Captures of one file at most.
FILE_RECORDS = 10_000
#: Bytes that are unpacked at once.
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"

RECORD = ("record_id string, record_type string, concurrent_to string, refers_to string, "
          "target_uri string, warc_date string, content_type string, fields string, "
          "payload_bytes bigint, payload_digest string, stated_digest string")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits at a time are four base-32 digits."""
    hexes = F.sha1(payload)
    return F.translate(F.concat(*[
        F.lpad(F.conv(F.substring(hexes, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]),
        CONV32, BASE32)


def _header(*lines: tuple[str, Column | str | None]) -> Column:
    """Header lines; those whose value is null are left out."""
    parts = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))
             .otherwise("") for name, value in (
        (n, F.lit(v) if isinstance(v, str) else v) for n, v in lines)]
    return F.concat(F.lit("WARC/1.1" + CRLF), *parts)


def _record(header: Column, block: Column) -> Column:
    return F.concat(header, F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                    F.lit(CRLF * 2), block, F.lit(CRLF * 2))


def _urn(*parts: Column | str) -> Column:
    digest = F.md5(F.concat_ws("|", *[
        F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null"))
        for p in parts]))
    cuts = [F.substring(digest, start, n) for start, n in (
        (1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def plan_captures(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Which capture of equal payloads is the response: p_key, p_first, one row per capture key.

    Of payloads of at least ``min_bytes`` bytes the smallest page_id is the
    response. Sums come before the shuffle, so a payload that a third of the
    pages share is not gathered anywhere.
    """
    captures = stored(pages.select("page_id", _payload_digest().alias("digest"), F.octet_length(
        _payload()).alias("n")).groupBy("page_id", "digest", "n").agg(F.count(F.lit(1)).alias("rows")),
        "warc-digests")
    firsts = captures.where(F.col("n") >= min_bytes).groupBy(
        F.col("digest").alias("f_digest")).agg(F.min("page_id").alias("first_id"))
    return captures.join(firsts, F.col("digest") == F.col("f_digest"), "left").select(
        _capture_key(F.col("page_id"), F.col("digest")).alias("p_key"), "n", "rows",
        F.coalesce("first_id", "page_id").alias("p_first"))


def _capture_key(page_id: Column, digest: Column) -> Column:
    return F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest)


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def _payload_digest() -> Column:
    return base32_sha1(_payload())


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES,
                   file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC files below ``path``.

    Every row is a capture. The payload is the html in UTF-8, null counting as empty. A null
    url leaves out the target; control characters in a url become blanks. Null page ids
    are written without an id. Rows that repeat an id and a html are numbered, by url; all rows of the
    smallest id are responses, and revisits refer to the first of them. A file
    holds about ``file_bytes`` of payload; a single very long payload may be more. Other columns are
    not read; an empty table writes no record.
    """
    plan = stored(plan_captures(pages, min_bytes), "warc-plan")
    n, size = plan.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("n"))).first()
    file_records = max(1, min(file_records, file_bytes // max(1, size // n))) if n else file_records
    rows = pages.select("page_id", F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ").alias("url"),
                        _payload().alias("payload"), _payload_digest().alias("digest"))
    rows = rows.withColumn("key", _capture_key(F.col("page_id"), F.col("digest")))
    # By page id: no key of this join is frequent, whatever payloads repeat.
    rows = rows.join(plan.select("p_key", "p_first"), F.col("key") == F.col("p_key")).withColumn(
        "number", F.row_number().over(W.partitionBy("key").orderBy("url")))
    page, first = F.col("page_id"), F.col("p_first")
    # The first row of a capture key has the plain ids.
    number = F.when(F.col("number") > 1, F.concat(F.lit("|"), F.col("number").cast("string"))).otherwise("")
    digest = F.concat(F.col("digest"), number)
    is_first = page.eqNullSafe(first)
    capture = _urn("capture", page, digest)
    stated = F.concat(F.lit("sha1:"), F.col("digest"))
    uri, when = F.col("url"), ("WARC-Date", DATE)
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8"
                          + CRLF + "Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    response = _record(_header(
        ("WARC-Type", "response"), ("WARC-Record-ID", capture), when, ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", stated), ("Content-Type", "application/http;msgtype=response")),
        F.concat(http, F.col("payload")))
    revisit = _record(_header(
        ("WARC-Type", "revisit"), ("WARC-Record-ID", capture), when, ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", stated), ("WARC-Refers-To", _urn("capture", first, F.col("digest"))),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http;msgtype=response")), http)
    request = _record(_header(
        ("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", page, digest)), when,
        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", capture),
        ("Content-Type", "application/http;msgtype=request")),
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + CRLF * 2)))
    metadata = _record(_header(
        ("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", page, digest)), when,
        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", capture),
        ("Content-Type", "application/warc-fields")),
        F.coalesce(F.concat(F.lit("page_id: "), page.cast("string"), F.lit(CRLF)), F.lit("")))
    rows.select(F.concat(request, F.when(is_first, response).otherwise(revisit), metadata)
                .alias("value")).write.option("lineSep", CRLF).option(
        "compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


class _Bytes:
    """The bytes of an archive file, unpacked as they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.zipped = data[:2] == b"\x1f\x8b"
        self.member = zlib.decompressobj(31)

    def more(self) -> bool:
        """Unpacks a step; false at the end."""
        if self.at >= len(self.data) and not (self.zipped and self.member.unconsumed_tail):
            return False
        if not self.zipped:
            self.held += self.data[self.at:self.at + READ_BYTES]
            self.at += READ_BYTES
            return True
        raw = self.member.unconsumed_tail
        if not raw:
            raw = self.data[self.at:self.at + READ_BYTES]
            self.at += len(raw)
        self.held += self.member.decompress(raw, READ_BYTES)
        if self.member.eof:
            self.at -= len(self.member.unused_data)
            self.member = zlib.decompressobj(31)
        return True

    def find(self, mark: bytes) -> int:
        """Where the mark stands next, or -1 if it comes no more; bytes before it are kept."""
        start = 0
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _parse(data: bytes, payloads: bool) -> Iterator[tuple]:
    """The records of one archive file, gzipped (any number of members) or not, one at a time."""
    source = _Bytes(data)
    while (at := source.find(b"WARC/")) >= 0:
        source.take(at)
        head = {}
        for line in source.take(source.find(b"\r\n\r\n") + 4).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        block = source.take(int(head["content-length"]))
        kind, payload, fields = head.get("warc-type"), memoryview(block), None
        if head.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            payload = memoryview(block)[cut + 4 if cut >= 0 else 0:]
        if kind == "metadata":
            fields = block.decode("utf-8", "replace")
        has_payload = kind in ("response", "resource")
        yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"),
               head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"),
               head.get("content-type"), fields, len(payload) if has_payload else None,
               base64.b32encode(hashlib.sha1(payload).digest()).decode() if has_payload else None,
               (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
               bytes(payload) if payloads and has_payload else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of all archive files below ``path``.

    Size and digest are taken from the payload as read, not from its header.
    ``payloads`` adds the bytes of response payloads.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"bigint": pa.int64(), "binary": pa.binary()}.get(f.split()[1], pa.string())
             for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for row in _parse(data.as_py(), payloads):
                    rows.append(row)
                    size += len(row[11] or b"")
                    if len(rows) == 4096 or size > 1 << 24:
                        yield _batch(rows, names, types)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, types)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        path).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows))[:len(names)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture from records in any order.

    Columns: capture_id, record_type (response or revisit), request, response,
    metadata (structs, null where the archive has none), page_id (from the
    metadata fields), payload_bytes, payload_digest (of the full payload: a revisit
    takes them from the response it refers to, and is null where that is not in
    the archives), refers_to (page_id of that response). Records that repeat an
    id count once. A request or metadata record that is concurrent to nothing
    read, or to nothing at all, gives no row. Payloads are not read here, so their length does
    not matter; other columns of ``records`` are not read; no records give no rows.
    """
    def of(kind: str, side: str) -> DataFrame:
        chosen = records.where(F.col("record_type") == kind).dropDuplicates(["record_id"])
        return chosen.where(F.col("concurrent_to").isNotNull()).select(
            F.col("concurrent_to").alias(f"{side}_key"), F.struct(
                "record_id", "target_uri", "warc_date", "content_type", "fields").alias(side)
        ).dropDuplicates([f"{side}_key"])

    captures = records.where(F.col("record_type").isin("response", "revisit")).dropDuplicates(
        ["record_id"])
    joined = captures.join(of("request", "request"), F.col("record_id") == F.col("request_key"),
                           "left").join(
        of("metadata", "metadata"), F.col("record_id") == F.col("metadata_key"), "left")
    page = F.regexp_extract(F.col("metadata.fields"), r"(?m)^page_id: (-?\d+)\r?$", 1)
    captures = stored(joined.withColumn("page_id", F.when(page != "", page).cast("bigint")),
                      "warc-captures")
    first = captures.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("first_record"), F.col("page_id").alias("first_page"),
        F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    return captures.join(first, F.col("refers_to") == F.col("first_record"), "left").select(
        F.col("record_id").alias("capture_id"), "record_type", "page_id", "request",
        F.struct("record_id", "target_uri", "warc_date", "content_type",
                 "stated_digest").alias("response"), "metadata",
        F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "first_digest").alias("payload_digest"),
        F.col("first_page").alias("refers_to"))


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and put together."""
    path = work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = stored(read_archives(spark, path), "warc-records")
    return assemble(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (
  SELECT page_id, n::BIGINT AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER,
      1)), 'string_agg', '') AS payload_digest FROM h),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
