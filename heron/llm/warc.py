"""WARC archives: written as one gzip member per record, and read back record by record.

An archive is a row (archive, content): the bytes of one .warc.gz file of about SEGMENT bytes, so
that archives live in any store that Spark writes to and each can be read by another task. Records
with equal payloads are written once as a response; the others are revisits that refer to it.

Cases: a null html is an empty payload; empty payloads are equal payloads like any other; rows of
the winning page_id are all responses; a null page_id is written and read as null and wins only
where the group has no other; a url with control characters is percent-encoded; an empty table
gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.plans.session import cut, table

SEGMENT = 4 << 20
#: Bytes given to the decompressor at a time.
STEP = 64 << 10
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, verified boolean"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """One record as a gzip member: a revisit if it refers to another page, else a response."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: quote(m[0]), url)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_PAGE}{refers_to}>")]
        return _member(fields, http)
    return _member(fields, http + payload)


def members(data: bytes) -> Iterator[bytes]:
    """The records of one archive, in order; each member is decompressed a step at a time."""
    at = 0
    while at < len(data):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(inflate.decompress(data[at : at + STEP]))
            at = min(len(data), at + STEP) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; the block is framed by Content-Length and its digest is verified."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not end or not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        k, _, v = line.decode().partition(":")
        fields[k.strip().lower()] = v.strip()
    size = int(fields["content-length"])
    if len(rest) < size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record does not fit its Content-Length")
    block = rest[:size]
    if fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("the block does not fit its digest")
    return fields, block


def _page(uri: str) -> int | None:
    number = uri.strip("<>").removeprefix(_PAGE)
    return int(number) if number else None


def read_record(raw: bytes) -> tuple | None:
    """A row of READ for a response or revisit; None for other records."""
    fields, block = parse(raw)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    verified = kind == "revisit" or (len(payload) == size and digest(payload) == named)
    if not verified:
        raise ValueError("the payload does not fit its digest")
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, size, named, payload if kind == "response" else None, verified


def _write(batches):
    part, k, size, parts = TaskContext.get().partitionId(), 0, 0, []

    def archive():
        name = f"pages-{part:06d}-{k:06d}.warc.gz"
        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        return pa.RecordBatch.from_pydict({"archive": pa.array([name]), "content": pa.array([info + b"".join(parts)], pa.binary())})

    for b in batches:
        for page_id, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            parts.append(record(page_id, url, html, refers))
            size += len(parts[-1])
            if size >= SEGMENT:
                yield archive()
                k, size, parts = k + 1, 0, []
    if parts:
        yield archive()


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content) rows that hold a record for every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keys = rows.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"))
    # Only digests and ids are shuffled to find the winners; partial maxima keep a common payload from one task.
    # Written, so that Spark knows their size: few are broadcast, and of many, a hot payload's rows are split over tasks.
    winners = cut(keys.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n"), "winners")
    rows = rows.withColumn("sha", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    tagged = rows.join(winners, "sha", "left")
    return tagged.select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to")
    ).mapInArrow(_write, "archive string, content binary")


def _read(with_payload: bool):
    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = [r for raw in members(data) if (r := read_record(raw))]
                cols = list(zip(*rows, strict=True)) or [()] * 8
                if not with_payload:
                    cols[6] = [None] * len(rows)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row of READ for each response and revisit; a broken frame or digest fails the task."""
    return archives.select("content").mapInArrow(_read(with_payload), READ)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    archives = cut(write_archives(table(spark, sf_dir, "pages")), "warc")
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: 40 hex digits are eight groups of 20 bits, each four base-32 letters.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM p
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM w
"""
