"""Media columns: payloads as PNG images in a binary column, read back, checked and hashed by their low frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, written

#: Pixels of a row; three 8-bit samples each.
WIDTH = 64
ROW = 3 * WIDTH
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of compressed samples in one IDAT chunk, at most.
IDAT_BYTES = 1 << 16

#: The side of the reduced image, and of the block of low frequencies kept.
REDUCED, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def payload(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text (null: none), and with spaces appended up to a positive multiple of a row."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))


def encode(data: bytes, level: int = 6) -> bytes:
    """An RGB PNG of whole rows. All rows have one filter, None, Sub or Up: the one whose residues have the least entropy."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, 3:] -= rows[:, :-3]
    up[1:] -= rows[:-1]
    kind = int(np.argmax([(n * np.log2(np.maximum(n, 1))).sum() for n in (np.bincount(x.reshape(-1), minlength=256) for x in (rows, sub, up))]))
    filtered = np.empty((len(rows), ROW + 1), np.uint8)
    filtered[:, 0] = kind
    filtered[:, 1:] = (rows, sub, up)[kind]
    packed = zlib.compress(filtered.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[k : k + IDAT_BYTES]) for k in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes filters 0 to 4 row by row; None, Sub and Up over whole rows at once."""
    out = np.zeros_like(rows)
    if (kinds == 0).all():
        return rows
    if (kinds == 2).all():
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    if (kinds == 1).all():
        return np.cumsum(rows.reshape(len(rows), -1, step), axis=1, dtype=np.uint8).reshape(rows.shape)
    before = np.zeros(rows.shape[1], np.uint8)
    for r, kind in enumerate(kinds.tolist()):
        if kind == 0:
            out[r] = rows[r]
        elif kind == 1:
            out[r] = np.cumsum(rows[r].reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[r] = rows[r] + before
        elif kind in (3, 4):
            for k in range(0, rows.shape[1], step):
                left = out[r, k - step : k].astype(np.int16) if k else np.zeros(step, np.int16)
                above = before[k : k + step].astype(np.int16)
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    corner = before[k - step : k].astype(np.int16) if k else np.zeros(step, np.int16)
                    p = left + above - corner
                    a, b, c = np.abs(p - left), np.abs(p - above), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
                out[r, k : k + step] = rows[r, k : k + step] + guess.astype(np.uint8)
        else:
            raise ValueError(f"filter {kind}")
        before = out[r]
    return out


def decode(png: bytes) -> np.ndarray:
    """The samples of an 8-bit RGB or grey PNG, rows by bytes. A bad signature, checksum, or length is an error."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(png):
        if len(png) < at + 12:
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + size]
        if len(png) < at + 12 + size or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        ended |= kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        raise ValueError("no 8-bit RGB or grey image")
    step = 3 if head[3] == 2 else 1
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head[1], head[0] * step + 1)
    return _unfilter(rows[:, 0], rows[:, 1:], step)


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


_BASIS = _cosines(REDUCED)


def low_frequency_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the image, reduced to 32 x 32 grey, exceed their median (the constant one aside)."""
    grey = samples.reshape(len(samples), WIDTH, -1).mean(axis=2)
    cuts = np.linspace(0, len(grey), REDUCED + 1)
    low, high = np.floor(cuts[:-1]).astype(int), np.maximum(np.ceil(cuts[1:]).astype(int), np.floor(cuts[:-1]).astype(int) + 1)
    sums = np.vstack([np.zeros((1, WIDTH)), np.cumsum(grey, axis=0)])
    rows = (sums[np.minimum(high, len(grey))] - sums[low]) / (np.minimum(high, len(grey)) - low)[:, None]
    reduced = rows.reshape(REDUCED, REDUCED, WIDTH // REDUCED).mean(axis=2)
    freq = np.round(_BASIS @ reduced @ _BASIS.T, 6).reshape(-1)
    return np.packbits(freq > np.median(freq[1:])).tobytes()


def images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and png (binary) of each row; null and empty texts give one row of spaces. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                own = [payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in own], pa.int64()), pa.array([encode(x) for _, x in own], pa.binary())], names=["doc_id", "n_bytes", "png"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, png binary")


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and from each png: payload_bytes, payload_sha256, tail_crc32 (of the last 16), media_bytes, media_sha256, hash (binary). A damaged png fails the job."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 2):
                out = []
                for png in part.column(2).to_pylist():
                    samples = decode(png)
                    data = samples.tobytes()
                    out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(png), hashlib.sha256(png).hexdigest(), low_frequency_hash(samples)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"],
                )

    return stored.select("doc_id", "n_bytes", "png").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")


def media(docs: DataFrame) -> DataFrame:
    """Writes docs' texts as images and reads them back: see images() and read_back(). Equal texts give equal values; nulls in doc_id stay; an empty table gives none."""
    return read_back(written(images(docs))).withColumn("feature", F.lower(F.hex("hash")))
