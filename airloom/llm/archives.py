"""Web pages in WARC archives: writing them, and reading damaged ones.

The project has no web records; pages are general here, ``(page_id, url, html)``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.common import written

#: Fixed value: the base32 digits of RFC 4648.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
CHUNK = 1 << 16
BATCH_BYTES = 1 << 23
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
#: The end of headers, or a line that begins the next record before it.
_STOP = re.compile(rb"\r\n\r\n|\r\n(?=WARC/1\.[01]\r\n)")
SCHEMA = (
    "archive string, offset bigint, length bigint, gap string, record_type string, "
    "record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes bigint, payload binary"
)


def payload_digest(payload: Column) -> Column:
    """The SHA-1 of a text's UTF-8 bytes in base32."""
    digits = []
    for group in range(8):
        bits = F.conv(F.substring(F.sha1(payload), 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            digits.append(F.substring(F.lit(DIGITS), place, F.lit(1)))
    return F.concat(*digits)


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    records_per_file: int = 2000,
) -> None:
    """Write one record per page as WARC files below ``folder``.

    Of pages with equal payloads (the html in UTF-8; NULL is empty) that with the smallest id is
    a ``response`` and the others are ``revisit`` records that refer to it and have no payload of
    their own. Pages without an id refer to one with an id and are never referred to; rows
    that repeat the smallest id are all responses. White space and control characters in addresses
    are escaped; a page without an address has none in its record.

    Files are written by Spark, so to any storage that it reaches, and hold ``records_per_file``
    records at most.
    """
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        text.alias("html"),
        payload_digest(text).alias("digest"),
    )
    first = written(
        rows.groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first"),
        "archive-copies",
    )
    copy = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(copy, head).otherwise(F.concat(head, F.col("html")))
    name = lambda value: F.concat(
        F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(">")
    )
    address = F.concat(
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20"), F.lit("\r\n")
    )
    marks = F.when(
        copy,
        F.concat(
            F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n")
        ),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(copy, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(address, F.lit("")),
        F.coalesce(marks, F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
        F.col("block"),
        F.lit("\r\n"),
    )
    # The line end that the text writer adds is the second half of the mark after a record.
    (
        rows.join(first, "digest", "left")
        .withColumn("block", block)
        .select(record.alias("record"))
        .write.option("lineSep", "\r\n")
        .option("maxRecordsPerFile", records_per_file)
        .text(folder)
    )


class Damaged(Exception):
    """A record that fails a check; the text says which."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int | None
    size: int = field(default=0)


def _head_end(data: bytes, at: int, known: list[int]) -> int:
    """Where the headers around ``at`` end, or -1; ``known`` is the last search, valid up to its end."""
    if not known or not known[0] <= at <= known[1]:
        stop = _STOP.search(data, at)
        known[:] = [at, stop.start(), stop.end()] if stop else [at, len(data), len(data)]
    return known[1] if known[2] - known[1] == len(END) else -1


def parse_record(data: bytes, at: int = 0, known: list[int] | None = None) -> Record:
    """The record that starts at ``at``, with its length in the archive; checks it in full.

    Headers may have any length. ``known`` keeps the last search for their end, so that an archive
    with many false version lines is not searched again from each.
    """
    start = _START.match(data, at)
    if not start or data[at] == 0x1F:
        raise Damaged("no version line")
    end = _head_end(data, start.end() - 2, [] if known is None else known)
    if end < 0:
        raise Damaged("no end of headers")
    headers = _headers(data[start.end() : end])
    length = _length(headers)
    if length is None:
        raise Damaged("no length")
    block = data[end + 4 : end + 4 + length]
    if data[end + 4 + length : end + 8 + length] != END:
        raise Damaged("wrong length")
    kind = headers.get("warc-type", "")
    payload, payload_bytes = block, length
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(END)
        if cut < 0:
            raise Damaged("no end of HTTP headers")
        payload = block[cut + 4 :]
        said = _length(_headers(block[:cut]))
        payload_bytes = len(payload) if said is None else said
    if kind == "revisit":
        payload = None
    elif headers.get("warc-payload-digest", "").startswith("sha1:"):
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if headers["warc-payload-digest"] != f"sha1:{digest}":
            raise Damaged("wrong digest")
        payload_bytes = len(payload)
    return Record(kind, headers, payload, payload_bytes, end + 8 + length - at)


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n"))
    return {
        name.strip().lower().decode("latin-1"): value.strip().decode("utf-8", "replace")
        for name, mark, value in pairs
        if mark
    }


def _length(headers: dict[str, str]) -> int | None:
    value = headers.get("content-length", "")
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value) else None


def parse_member(data: bytes, at: int) -> Record:
    """The record in the gzip member that starts at ``at``."""
    opened, out, place = zlib.decompressobj(31), [], at
    view = memoryview(data)
    try:
        while not opened.eof:
            chunk = view[place : place + CHUNK]
            if not chunk:
                raise Damaged("member without end")
            out.append(opened.decompress(chunk))
            place += len(chunk)
    except zlib.error as error:
        raise Damaged("broken member") from error
    record = parse_record(inner := b"".join(out))
    if record.size != len(inner):
        raise Damaged("more than one record in a member")
    record.size = place - len(opened.unused_data) - at
    return record


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, Record | None]]:
    """``(offset, length, gap, record)`` over a whole archive, without a byte left out.

    After a record or member that fails a check, the next version line or member is searched at
    which a record passes all of them; what lies between is a gap, with the check that failed.
    """
    at, gap, reason, known = 0, None, None, []
    while at < len(data):
        try:
            record = parse_member(data, at) if data[at] == 0x1F else parse_record(data, at, known)
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, reason, None
            gap = None
        yield at, record.size, None, record
        at += record.size
    if gap is not None:
        yield gap, len(data) - gap, reason, None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record and every gap of the archives below ``folder``, plain or compressed by record.

    ``(archive, offset, length, gap, record_type, record_id, target_uri, refers_to, payload_digest,
    payload_bytes, payload)``. A row is a record, or a quarantined stretch of bytes for which ``gap``
    says what was wrong; offsets and lengths cover each archive without overlap. ``payload_bytes``
    of a revisit is the length its HTTP headers state. An empty archive has no rows. An archive
    is read as one value, so it must be smaller than 2 GB and fit in an executor a few times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for offset, length, gap, record in salvage(content.as_py() or b""):
                    rows.append((path.as_py(), offset, length, gap, *_values(record)))
                    size += length
                    if size >= BATCH_BYTES:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _values(record: Record | None) -> tuple:
    if record is None:
        return (None,) * 7
    get = record.headers.get
    digest = get("warc-payload-digest")
    return (
        record.kind,
        get("warc-record-id"),
        get("warc-target-uri"),
        get("warc-refers-to"),
        digest.removeprefix("sha1:") if digest else None,
        record.payload_bytes,
        record.payload,
    )


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def page_of(record_id: Column) -> Column:
    """The page id in a record id of :func:`write_archives`."""
    number = F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(number != "", number).cast("bigint")


def compressed(records: list[bytes]) -> bytes:
    """Records as an archive of gzip members."""
    return b"".join(gzip.compress(record, mtime=0) for record in records)
