"""Vector codes: product quantisation in integers, with an exact early stop by Walsh-Hadamard coefficients.

A vector's components become integers, its parts and the codebooks' entries are zero-padded to a power of two, P, and
transformed by the integer Walsh-Hadamard transform, whose rows come in sequency order (by their numbers of sign
changes). The transform keeps squared distances but for the factor P, so sums of squared differences over the first
coefficients are lower bounds of P times a distance: an entry whose sum exceeds the whole distance of another one is out,
and ties stay in until the lowest index is taken. All of it is in integers: 64 bits where no sum can leave them, Python's
own otherwise.

Codebooks and what a round gathers for them are a few numbers (parts x entries x their components); vectors are read
again each round, and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components saturate there, so that sums over 10**13 vectors stay within a decimal of 38 digits.
LIMIT = 10**24
#: Vectors that are worked on at once.
ROWS = 2048
_LONG = 2**63 - 1


def sequency(size: int) -> np.ndarray:
    """The places of the Hadamard matrix's rows (of its recursive construction) in the order of their sign changes. size: a power of two."""
    bits, order = size.bit_length() - 1, []
    for k in range(size):
        gray = k ^ (k >> 1)
        order.append(sum(((gray >> j) & 1) << (bits - 1 - j) for j in range(bits)))
    return np.array(order)


def walsh(x: np.ndarray) -> np.ndarray:
    """The transform of the last axis, zero-padded to a power of two, in sequency order."""
    width = x.shape[-1]
    size = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((*x.shape[:-1], size), x.dtype)
    out[..., :width] = x
    h = 1
    while h < size:
        pairs = out.reshape(*x.shape[:-1], size // (2 * h), 2, h)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(out.shape)
        h *= 2
    return out[..., sequency(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed row the index of the nearest transformed entry, the lowest of equally near ones, and P times its squared distance."""
    size = rows.shape[1]
    head = max(1, size // 4)
    sums = ((rows[:, None, :head] - entries[None, :, :head]) ** 2).sum(axis=2)
    guess = sums.argmin(axis=1)
    bound = ((rows - entries[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums, at, step = sums[row, entry], head, head
    while at < size:
        sums = sums + ((rows[row, at : at + step] - entries[entry, at : at + step]) ** 2).sum(axis=1)
        left = sums <= bound[row]
        row, entry, sums, at = row[left], entry[left], sums[left], at + step
    # Pairs come by row, then by index; the guess is among its row's.
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(sums, first) if len(row) else sums
    best = np.flatnonzero(sums == least[row])
    best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
    return entry[best], sums[best]


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component, zero-padded to PARTS * width: a row a vector."""
    flat = np.floor(pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False) * SCALE)
    small = not len(flat) or np.abs(flat).max() < 2**52
    whole = flat.astype(np.int64) if small else np.array([max(-LIMIT, min(LIMIT, int(x))) for x in flat.tolist()], object)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), PARTS * width), whole.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


class Codebooks:
    """books[part][entry]: integer components, as many as a part has."""

    def __init__(self, books: list[list[list[int]]], width: int):
        self.books, self.width = books, width
        self.most = max((abs(c) for part in books for entry in part for c in entry), default=0)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.books for entry in part for c in entry).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's entries by part, and its squared distances by part."""
        size = 1 << max(self.width - 1, 0).bit_length()
        most = max(self.most, int(np.abs(vectors).max()) if vectors.size else 0)
        kind = np.int64 if 4 * most * most * size * size < 2**62 else object  # no sum leaves 64 bits
        found, far = np.zeros((len(vectors), PARTS), np.int64), np.zeros((len(vectors), PARTS), kind)
        if not self.width or not len(vectors):
            return found, far
        for p in range(PARTS):
            rows = walsh(vectors[:, p * self.width : (p + 1) * self.width].astype(kind))
            found[:, p], scaled = nearest(rows, walsh(np.array(self.books[p], dtype=kind)))
            far[:, p] = scaled // rows.shape[1]
        return found, far


def kept(vectors: DataFrame) -> DataFrame:
    """Rows whose vector holds finite components only."""
    return vectors.where("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def fitted(own: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of kept rows (vec_id, embedding) after the rounds."""
    longest = own.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // PARTS)
    first = own.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    start = integers(pa.array([r.embedding for r in first], pa.list_(pa.float64())), width)
    now = Codebooks([[[int(c) for c in v[p * width : (p + 1) * width]] for v in start] for p in range(PARTS)], width)
    if not first or not width:
        return now
    for _ in range(rounds):
        books = now

        def sums(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            k, w = len(books.books[0]), books.width
            total, n = np.zeros((PARTS * k, w), object), np.zeros(PARTS * k, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    vectors = integers(batch.column(0).slice(at, ROWS), w)
                    found, _ = books.assign(vectors)
                    for p in range(PARTS):
                        order = np.argsort(found[:, p], kind="stable")
                        held, begin, count = np.unique(found[order, p], return_index=True, return_counts=True)
                        total[p * k + held] += np.add.reduceat(vectors[order, p * w : (p + 1) * w], begin, axis=0).astype(object)
                        n[p * k + held] += count
            used = np.flatnonzero(n)
            if len(used):
                cell = np.repeat(used, w)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.tile(np.arange(w), len(used))), _decimals(total[used].ravel().tolist()), pa.array(n[cell])], names=["cell", "i", "total", "n"])

        # parts x entries x components rows come back, whatever the number of vectors.
        rows = own.select("embedding").mapInArrow(sums, "cell long, i long, total decimal(38,0), n long").groupBy("cell", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        k = len(now.books[0])
        moved = [[list(entry) for entry in part] for part in now.books]
        for r in rows:
            moved[r.cell // k][r.cell % k][r.i] = int(r.total) // r.n
        now = Codebooks(moved, width)
    return now


def _totals(done: DataFrame) -> DataFrame:
    """done with label_error: the error summed over equal labels. Sums by label are broadcast up to a checked number; beyond it a join that Spark can split shuffles."""
    sums = written(done.groupBy(F.col("label").alias("_of")).agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")))
    return done.join(F.broadcast(sums) if sums.count() <= BROADCAST else sums, F.col("label").eqNullSafe(F.col("_of")), "left").drop("_of")


def _long(total: Column) -> Column:
    return F.least(total, F.lit(Decimal(_LONG))).cast("long")


def coded(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error, label_error of each kept row of vectors (vec_id, embedding, label), and the codebooks.

    Dropped: rows whose vector is null or holds null or non-finite components. Vectors are zero-padded at their end to the
    longest one's length, rounded up to a multiple of PARTS; an empty one is all zeros. The first entries are those of the
    smallest vec_ids, null last, of equal ids the least vectors; with fewer than ENTRIES rows there are fewer entries. Rows
    that repeat each get a row and each count. Components beyond LIMIT saturate there, errors and their sums at the largest
    long. Null labels are equal to one another. An empty table gives none. Other columns are ignored.
    """
    own = kept(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    books = fitted(own, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found, far = books.assign(integers(part.column(1), books.width))
                code = [bytes(row).hex() for row in found.astype(np.uint8)]
                error = [min(_LONG, sum(row)) for row in far.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    done = written(own.mapInArrow(run, f"vec_id long, label {own.schema['label'].dataType.simpleString()}, code string, error long"))
    return _totals(done), books
