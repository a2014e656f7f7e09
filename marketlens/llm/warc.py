"""WARC archives in seekable Zstandard bundles.

A bundle is one .warc.zst file: independent frames, each of whole records, then a seek table in a skippable frame (the
public seekable format: sizes of each frame, compressed and not, and a footer). A bundle is a row with the file's
bytes; beside it stands an index row per record: bundle, frame, and the record's place within the frame, so that one
record costs one frame. Bundles are bounded in size, and stay where their records were.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

_STAMP = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload behind HTTP headers, or a revisit with those headers alone."""
    clean = "".join(c for c in (url or "") if c > " ") or "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {_STAMP}",
        f"WARC-Target-URI: {clean}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[6:6] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers of the record at a place in a frame, its block, and where the next one starts."""
    end = frame.index(b"\r\n\r\n", at)
    first, *lines = frame[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    block = frame[end + 4 : end + 4 + n]
    if len(block) != n or frame[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return headers, block, end + 8 + n


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and full size of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    start = len(bundle) - 9 - 8 * n
    if struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("a damaged seek table")
    out, at = [], 0
    for k in range(n):
        c, d = struct.unpack_from("<II", bundle, start + 8 * k)
        out.append((at, c, d))
        at += c
    if at != start - 8:
        raise ValueError("frames and seek table differ")
    return out


class _Bundle:
    def __init__(self) -> None:
        self.name, self.done, self.sizes, self.open, self.entries = uuid.uuid4().hex, [], [], bytearray(), []
        self.packed = 0

    def add(self, page: int | None, data: bytes) -> None:
        self.entries.append((page, self.name, len(self.sizes), len(self.open)))
        self.open += data
        if len(self.open) >= FRAME_BYTES:
            self.close()

    def close(self) -> None:
        if self.open:
            packed = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress(bytes(self.open))
            self.sizes.append((len(packed), len(self.open)))
            self.done.append(packed)
            self.packed += len(packed)
            self.open = bytearray()

    def whole(self) -> bytes:
        self.close()
        return b"".join(self.done) + seek_table(self.sizes)


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with payload_digest and refers_to: for payloads of at least `least` bytes, the smallest page_id with the same one, unless that is the page's own."""
    own = pages.select("page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    own = own.withColumn("key", F.sha1(F.col("html").cast("binary")))
    # Only groups of two pages or more are looked up; those are few and the others aren't shuffled twice.
    low = own.where(F.octet_length("html") >= least).groupBy("key").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1 AND low IS NOT NULL").select("key", "low")
    return own.join(low, "key", "left").select("page_id", "url", "html", F.expr("IF(page_id <=> low, NULL, low)").alias("refers_to"))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """A table of bundles (name, data) and of index rows (page_id, name, frame, place), told apart by data being null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Bundle()

        def rows() -> pa.RecordBatch:
            data = now.whole()
            e = now.entries
            return pa.RecordBatch.from_arrays(
                [pa.array([now.name, *(x[1] for x in e)]), pa.array([data, *(None for _ in e)], pa.binary()), pa.array([None, *(x[0] for x in e)], pa.int64()), pa.array([None, *(x[2] for x in e)], pa.int32()), pa.array([None, *(x[3] for x in e)], pa.int32())],
                names=["name", "data", "page_id", "frame", "place"],
            )

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, refers_to = (batch.column(c)[k].as_py() for c in range(4))
                now.add(page, record(page, url, html.encode(), refers_to))
                if now.packed >= BUNDLE_BYTES:
                    yield rows()
                    now = _Bundle()
        if now.entries:
            yield rows()

    return typed(pages, least).mapInArrow(run, "name string, data binary, page_id long, frame int, place int")


def read_back(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the files alone: frames by the seek table, records one after another. Payloads are checked against their digests."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "name", "frame", "place"]

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, bundle, out = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), []
                for frame, (at, size, full) in enumerate(frames_of(bundle)):
                    data = zstandard.ZstdDecompressor().decompress(bundle[at : at + size])
                    if len(data) != full:
                        raise ValueError("a frame's size differs from the seek table's")
                    place = 0
                    while place < full:
                        headers, block, after = parse(data, place)
                        http, _, body = block.partition(b"\r\n\r\n")
                        n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        kept = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (len(body) != n or digest(body) != kept):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']}")
                        out.append((number(headers["WARC-Record-ID"]), n, kept, headers["WARC-Type"], number(headers.get("WARC-Refers-To")), name, frame, place))
                        place = after
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, name string, frame int, place int"
    return bundles.where("data IS NOT NULL").select("name", "data").mapInArrow(run, schema)


def fetch(bundle: bytes, frame: int, place: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: only its frame is decompressed."""
    at, size, _ = frames_of(bundle)[frame]
    headers, block, _ = parse(zstandard.ZstdDecompressor().decompress(bundle[at : at + size]), place)
    return headers, block


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes a record per row of pages, and reads the archives back.

    Null html is an empty payload; a null url is about:blank; a null page_id stays null and is referred to by none.
    Rows that repeat a page are records of their own, all responses if theirs is the smallest page_id of their payload.
    An empty table gives no bundle and no row. Other columns are ignored.
    """
    held = written(archived(pages, least))
    return read_back(held)
