"""Eigenvalues of correlations of many names, without their matrix on the driver, and how far it should be shrunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.sink import written

#: Names whose products travel in one row.
CHUNK = 256


def _values(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(0)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _added(parts: DataFrame) -> DataFrame:
    """at, flat: the sums of parts' flat by at, added up as they come, so that a task holds a row for each at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, flat in zip(batch.column("at").to_pylist(), batch.column("flat"), strict=True):
                own = flat.values.to_numpy(zero_copy_only=False)
                held[at] = held[at] + own if at in held else own.copy()
        for at, flat in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], names=["at", "flat"])

    return parts.mapInArrow(run, "at int, flat array<double>").repartition("at").mapInArrow(run, "at int, flat array<double>")


def _mapped(rows: DataFrame, of: object) -> DataFrame:
    """at, flat: chunks of what of() makes of each batch of rows, a matrix with a row a name; the sums over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = _values(batch)
                for at in range(0, z.shape[1], CHUNK):
                    part = of(z, slice(at, at + CHUNK))
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.ravel()], pa.list_(pa.float64()))], names=["at", "flat"])

    return _added(rows.mapInArrow(run, "at int, flat array<double>"))


def _product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """Z'(Z q) for the matrix Z of rows: what comes back is of q's size."""
    held = rows.sparkSession.sparkContext.broadcast(q)
    found = _mapped(rows, lambda z, own: z[:, own].T @ (z @ held.value)).collect()
    return np.concatenate([np.array(r.flat) for r in sorted(found)]).reshape(q.shape)


def standardised(vectors: DataFrame, column: str = "features") -> DataFrame:
    """z: rows' vectors (arrays) less their mean, over their standard deviation (population); a name that doesn't vary is 0. Vectors that are null, or hold a null, NaN or infinite value, are left out. Written once."""
    whole = vectors.select(F.col(column).cast("array<double>").alias("z")).where("z IS NOT NULL AND forall(z, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = written(whole)
    n = rows.count()
    if not n:
        return rows
    # Means first: squares about them don't cancel.
    mean = np.concatenate([np.array(r.flat) for r in sorted(_mapped(rows, lambda z, own: z[:, own].sum(0)).collect())]) / n
    held = rows.sparkSession.sparkContext.broadcast(mean)
    square = np.concatenate([np.array(r.flat) for r in sorted(_mapped(rows, lambda z, own: ((z[:, own] - held.value[own]) ** 2).sum(0)).collect())]) / n
    over = np.where(square > 1e-24 * (1 + mean**2), 1 / np.sqrt(np.where(square > 0, square, 1)), 0.0)
    scale = rows.sparkSession.sparkContext.broadcast((mean, over))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = (_values(batch) - scale.value[0]) * scale.value[1]
                ends = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))], names=["z"])

    return written(rows.mapInArrow(run, "z array<double>"))


def eigenvalues(rows: DataFrame, k: int, tolerance: float = 1e-5, seed: int = 7, extra: int = 8) -> np.ndarray:
    """The k largest eigenvalues of Z'Z / n for the matrix Z of rows (z), descending.

    A randomised range finder: a block of k + extra random directions, and what Z'Z makes of it again and again, each new
    block orthogonal to the ones before, until the k largest values' residuals are below tolerance times the largest (the
    values' errors are of its square), or the directions span all names. A round is one pass over rows.
    """
    n, p = rows.count(), len(rows.first().z)
    k = min(k, p)
    width = min(k + extra, p)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, width)))[0]
    basis, image = np.empty((p, 0)), np.empty((p, 0))
    while True:
        basis, image = np.hstack([basis, block]), np.hstack([image, _product(rows, block) / n])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        rest = np.linalg.norm(image @ vectors - basis @ vectors * values, axis=0)
        if basis.shape[1] >= p or rest.max() <= tolerance * max(values[0], 1e-300):
            return values
        block = image[:, -block.shape[1] :]
        for _ in range(2):  # twice is enough
            block = block - basis @ (basis.T @ block)
        left, sizes, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, sizes > 1e-12 * max(values[0], 1e-300)][:, : p - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:
            return values


def spectrum_noise(vectors: DataFrame, k: int, column: str = "features") -> DataFrame:
    """nth, eigenvalue, noise_bound, is_signal: the k largest eigenvalues of the vectors' correlation against the Marchenko-Pastur bound for noise. vectors: a row a day, an array with a value a name; see standardised() for odd ones. No rows give none."""
    rows = standardised(vectors, column)
    n, first = rows.count(), rows.first()
    found = []
    if first is not None:
        bound = (1 + (len(first.z) / n) ** 0.5) ** 2
        found = [(i, float(v), float(bound), bool(v > bound)) for i, v in enumerate(eigenvalues(rows, k))]
    return vectors.sparkSession.createDataFrame(found, "nth int, eigenvalue double, noise_bound double, is_signal boolean")


def shrinkage(vectors: DataFrame, column: str = "features") -> DataFrame:
    """One row: n, p, and how far the correlation should be shrunk to the identity (Ledoit and Wolf's rule on the standardised vectors), with its mean squared entry off the diagonal before and after.

    The products of names are summed in chunks and squared where they are: the driver gets sums alone. A task holds the
    products of all names, p x p values. No rows give none.
    """
    schema = "n long, p long, shrinkage double, raw double, shrunk double"
    rows = standardised(vectors, column)
    n, first = rows.count(), rows.first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    p = len(first.z)
    gram = _mapped(rows, lambda z, own: z[:, own].T @ z).select("at", F.aggregate("flat", F.lit(0.0), lambda a, x: a + x * x).alias("s"), F.expr(f"aggregate(sequence(0, size(flat) div {p} - 1), 0D, (a, i) -> a + flat[i * {p} + i + at])").alias("t"), F.expr(f"aggregate(sequence(0, size(flat) div {p} - 1), 0D, (a, i) -> a + power(flat[i * {p} + i + at], 2))").alias("d"))
    g = gram.agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("d").alias("d")).first()
    fourth = rows.select(F.expr("power(aggregate(z, 0D, (a, x) -> a + x * x), 2)").alias("f")).agg(F.sum("f")).first()[0]
    square, mu = g.s / n**2, g.t / n / p
    gap = square - p * mu**2  # squared distance from the scaled identity, and the part of it that is noise
    noise = min((fourth / n - square) / n, gap)
    share = noise / gap if gap > 0 else 0.0
    raw = (square - g.d / n**2) / (p * (p - 1)) if p > 1 else 0.0
    return vectors.sparkSession.createDataFrame([(n, p, float(share), float(raw), float(raw * (1 - share) ** 2))], schema)
