"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Text handled at once inside a Python task; bounds its memory whatever the length of the rows' batch.
BLOCK_BYTES = 4 << 20
#: A batch of rows on its way to a Python task.
BATCH_BYTES = 2 << 20
#: Ids that are broadcast, at most; beyond that a join shuffles.
BROADCAST = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine; the package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; one of our own only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again.

    A lost executor then costs a reread, not the work behind df.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From here on batches that go to Python tasks hold BATCH_BYTES or so, where the session has Spark's default of 64 MB: they lie outside the heap, several copies of each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, str(BATCH_BYTES))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with uid, a key of each row, written once so that it stays."""
    return written(docs.withColumn("uid", F.monotonically_increasing_id()))


def of_ids(own: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """own's rows with (left_semi) or without (left_anti) a uid in ids."""
    ids = written(ids.select("uid").distinct())
    return own.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "uid", how)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does that for ASCII texts, which it handles much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blocks(batch: pa.RecordBatch, text_index: int, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about block_bytes of text each (a longer text stands alone)."""
    lengths = batch.column(text_index)
    start = held = 0
    for row, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_pylist()):
        if held and held + n > block_bytes:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def raw(pattern: str) -> str:
    """SQL: a pattern as a literal."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def matches(text: str, pattern: str) -> str:
    """SQL: array of (s, e, m), each match's code point range and string, in order.

    The pieces between matches give the places. They are summed up within blocks of 256 matches and over the blocks, so
    that the lists that grow stay short. No match may be empty.
    """
    p, kind = raw(pattern), "array<struct<s: int, e: int, m: string>>"
    found = f"""filter(zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1),
        (m, before) -> named_struct('gap', char_length(before), 'size', char_length(m), 'm', m)), x -> x.m IS NOT NULL)"""
    own = f"""aggregate(block, named_struct('at', a.at, 'out', cast(array() AS {kind})),
        (c, x) -> named_struct('at', c.at + x.gap + x.size, 'out', array_append(c.out, named_struct('s', c.at + x.gap, 'e', c.at + x.gap + x.size, 'm', x.m))))"""
    return f"""flatten(aggregate(flatten(transform(array({found}), all -> transform(sequence(0, cast(size(all) / 256 AS int)), j -> slice(all, 256 * j + 1, 256)))),
        named_struct('at', 0, 'out', cast(array() AS array<{kind}>)),
        (a, block) -> element_at(transform(array({own}), r -> named_struct('at', r.at, 'out', array_append(a.out, r.out))), 1), a -> a.out))"""
