"""WARC archives: one gzip member per record, written and read sequentially.

*Writing.* Pages with equal payloads are found by digest; the smallest page_id of a payload of at
least ``REVISIT_BYTES`` bytes becomes the response, the others revisit it (HTTP head and digest,
no payload). Only pages whose digest occurs twice are shuffled, a bitmap lets all others pass.
Archives are byte strings of about ``ARCHIVE_BYTES`` bytes, rows of a table in the shared folder: Spark's own
writer commits them, so retried tasks leave no half-written archive.
*Reading.* Members are inflated piece by piece; a record is the head up to the empty line, then
Content-Length bytes; its block digest, and a response's payload digest, must match, and nothing may follow
but two line ends. A broken record raises ``ValueError``. Memory is one record and one piece.

A null html is an empty payload, a null url leaves out the target. Rows that repeat the response's
page_id are responses too. Null page ids count as largest: such a page is a response if no page
with an id has its payload. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import bitmap, in_bitmap, stored

ARCHIVE_BYTES = 4 << 20
PIECE_BYTES = 1 << 16
REVISIT_BYTES = 0
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One compressed record; ``refers_to`` makes it a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    headers += [
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(headers).encode() + END + block + END) + squeeze.flush()


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    inflate, out = zlib.decompressobj(31), []
    for piece in pieces:
        while piece:
            out.append(inflate.decompress(piece))
            piece = inflate.unused_data
            if inflate.eof:
                yield b"".join(out)
                inflate, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the archive ends inside a record")


def read_records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """Verified records of an archive that comes in pieces of any length."""
    for data in members(pieces):
        head, cut, rest = data.partition(END)
        lines = head.decode().split("\r\n")
        if not cut or not lines[0].startswith("WARC/1."):
            raise ValueError("no record head")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if len(rest) != size + len(END) or rest[size:] != END:
            raise ValueError("the content length does not match the record")
        record = Record(headers, rest[:size])
        if headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(record.block):
            raise ValueError("the block digest does not match the record")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + base32_sha1(record.payload):
            raise ValueError("the payload digest does not match the record")
        yield record


def write_archives(pages: DataFrame) -> tuple[DataFrame, str]:
    """pages(page_id, url, html) -> the stored table (archive binary), and its path."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long_enough = F.octet_length("html") >= REVISIT_BYTES  # equal digests have equal lengths
    several, _ = stored(
        rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", "first", F.xxhash64("digest").alias("key")),
        "copies",
    )
    bits = bitmap(several, "key")
    rows = rows.withColumn("key", F.xxhash64("digest"))

    def only(hit: bool):
        def part(batches):
            for b in batches:
                found = in_bitmap(bits.value, b.column("key").to_numpy())
                yield b.filter(pa.array(found if hit else ~found))

        return part

    shared = rows.mapInArrow(only(True), rows.schema).join(several.select("digest", "first"), "digest", "left")
    alone = rows.mapInArrow(only(False), rows.schema).withColumn("first", F.lit(None).cast("long"))
    columns = ["page_id", "url", "html", "first"]
    every = shared.select(columns).unionByName(alone.select(columns))

    def write(batches):
        held, size = [], 0
        for b in batches:
            for page, url, html, first in zip(*(b.column(c).to_pylist() for c in columns)):
                held.append(record_bytes(page, url, html.encode(), None if first == page else first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    return stored(every.mapInArrow(write, "archive binary"), "archives")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches):
        for b in batches:
            for archive in b.column(0).to_pylist():
                out: list[list] = [[] for _ in names]
                pieces = (archive[at : at + PIECE_BYTES] for at in range(0, len(archive or b""), PIECE_BYTES))
                for r in read_records(pieces):
                    http = dict(x.split(": ", 1) for x in r.block.partition(END)[0].decode().split("\r\n")[1:])
                    row = (
                        _page(r.headers["WARC-Record-ID"]),
                        int(http["Content-Length"]),
                        r.headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                        r.headers["WARC-Type"],
                        _page(r.headers.get("WARC-Refers-To")),
                    )
                    for values, v in zip(out, row):
                        values.append(v)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select(column).mapInArrow(read, schema)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(digest, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN first IS NOT DISTINCT FROM page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p JOIN f USING (digest)
"""
