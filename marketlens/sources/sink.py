"""Sinks and merges over Parquet tables. Parquet has no row-level updates: merges give the new rows, writes replace partitions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; one of our own only where it names none."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: what is used several times is worked out once, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partition_overwrite(df: DataFrame, base: str, partitions: Sequence[str]) -> None:
    """Replaces the partitions that df has rows of, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partitions).parquet(base)


def write_day_rebuild(df: DataFrame, base: str, day: date, vendor: str, day_col: str = "trade_date", vendor_col: str = "source_vendor") -> None:
    """Replaces a day's partition by df's rows of it; refused if rows of another writer are there."""
    spark = df.sparkSession
    own = df.where(F.col(day_col) == F.lit(day))
    try:
        before = spark.read.parquet(base).where(F.col(day_col) == F.lit(day))
        foreign = before.where(~F.col(vendor_col).eqNullSafe(F.lit(vendor))).limit(1).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        foreign = 0
    if foreign:
        raise ValueError(f"the partition of {day} has another writer's rows")
    write_partition_overwrite(own, base, [day_col])


def merge_append_new(target: DataFrame, batch: DataFrame, identity: Sequence[str], order: str) -> DataFrame:
    """The rows to append: of each identity in batch the last by order, if target has none."""
    last = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*identity).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return last.join(target.select(*identity), list(identity), "left_anti")


def upsert_changed(target: DataFrame, batch: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """All rows after an upsert, with action: created, updated (a value differs, nulls told apart), unchanged, or kept."""
    a = target.select(*key, F.struct(*values).alias("_old"))
    b = batch.select(*key, F.struct(*values).alias("_new"))
    j = a.join(b, list(key), "full")
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    now = F.coalesce("_new", "_old")
    return j.select(*key, *[now[v].alias(v) for v in values], action.alias("action"))


def insert_ignore(target: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of batch to insert: keys that target lacks, once each."""
    return batch.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


def upsert_extrema(target: DataFrame, batch: DataFrame, key: Sequence[str], mins: Sequence[str], maxs: Sequence[str], firsts: Sequence[str], order: str) -> DataFrame:
    """Rows after an upsert that keeps minima, maxima and the first value that isn't null, by order."""
    both = target.unionByName(batch)
    return both.groupBy(*key).agg(*[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts])


def partition_by_event_date(df: DataFrame, published: str, fallback: str, name: str = "partition_date") -> DataFrame:
    """df with the date of the partition a row belongs to: its own, or the day it came in."""
    return df.withColumn(name, F.coalesce(F.col(published).try_cast("date"), F.col(fallback).cast("date")))


def quality_log_sink(passed: DataFrame, quarantined: DataFrame, run_id: str, path: str | None = None) -> DataFrame:
    """A run's counts: passed, quarantined, and quarantined by reason; also appended as JSON to path."""
    ok = passed.agg(F.count("*").alias("n")).select(F.lit("passed").alias("what"), "n")
    bad = quarantined.agg(F.count("*").alias("n")).select(F.lit("quarantined").alias("what"), "n")
    why = quarantined.select(F.explode("reasons").alias("r")).groupBy("r").agg(F.count("*").alias("n")).select(F.concat(F.lit("reason:"), "r").alias("what"), "n")
    out = ok.unionByName(bad).unionByName(why).select(F.lit(run_id).alias("run_id"), "what", "n")
    if path:
        out.write.mode("append").json(path)
    return out


def long_item_backfill(df: DataFrame, key: Sequence[str], items: Sequence[str], base: str, partition: str) -> DataFrame:
    """Wide item columns as long rows (item_code, value), written by partition and read back."""
    long = df.select(*key, *[F.col(c).cast("double").alias(c) for c in items]).unpivot(list(key), list(items), "item_code", "value").where("value IS NOT NULL")
    write_partition_overwrite(long, base, [partition])
    return df.sparkSession.read.schema(long.schema).parquet(base)
