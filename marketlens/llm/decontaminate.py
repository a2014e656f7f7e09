"""Benchmark decontamination: a prefix-filtered set join, in DataFrame and SQL functions only.

An item's windows are sets of two-word shingles. Documents keep the runs of words all of whose shingles occur in the
benchmark and that are long enough for some window (length bound). A window needs each of its shingles, so its prefix
is one shingle, the rarest by corpus count; runs join windows on that prefix alone, positions bound where the window
may start, and the words themselves are then compared.

The benchmark is a small fixed set. Its shingles enter the documents' pass as a literal set of at most MAX_SHINGLES;
a larger benchmark is handled in several such blocks of windows, so what each task holds stays bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles of the benchmark held as a literal set in one pass over the documents.
MAX_SHINGLES = 100_000
#: Words of a run that one row holds, besides those that overlap with the next row's.
PIECE = 64

SHINGLES = "transform(sequence(1, size(w) - 1), i -> xxhash64(w[i - 1], w[i]))"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """The distinct windows of all items: w (words) and items (ids as strings, sorted)."""
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("all"))
        .where("size(all) > 0")
        .select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(all) - {size}, 0)), i -> slice(all, i + 1, {size}))")).alias("w"))
        .groupBy("w")
        .agg(F.collect_set("item").alias("items"))
    )


def _runs(shingles: list[int], singles: list[str], least: int) -> dict[str, Column]:
    """The columns runs (start, words), of documents' words w."""
    if shingles:
        held = ",".join(map(str, shingles))
        flags = F.expr(f"CASE WHEN size(w) >= 2 THEN array_join(transform(sequence(1, size(w) - 1), i -> IF(xxhash64(w[i - 1], w[i]) IN ({held}), '1', '0')), '') ELSE '' END")
        runs = F.expr(
            f"""CASE WHEN flags RLIKE '1{{{least}}}' THEN
            transform(aggregate(split(flags, '(?<=1)(?=0)|(?<=0)(?=1)'),
                named_struct('at', 0, 'out', cast(array() AS array<struct<s: int, n: int>>)),
                (a, x) -> named_struct('at', a.at + length(x), 'out', IF(startswith(x, '1') AND length(x) >= {least},
                    array_append(a.out, named_struct('s', a.at, 'n', length(x))), a.out))).out,
                r -> named_struct('s', r.s, 'w', slice(w, r.s + 1, r.n + 1)))
            ELSE cast(array() AS array<struct<s: int, w: array<string>>>) END"""
        )
    else:
        flags, runs = F.lit(""), F.expr("cast(array() AS array<struct<s: int, w: array<string>>>)")
    if singles:
        held = ",".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in singles)
        one = F.expr(f"filter(transform(w, (x, i) -> named_struct('s', i, 'w', array(x))), r -> r.w[0] IN ({held}))")
    else:
        one = F.expr("cast(array() AS array<struct<s: int, w: array<string>>>)")
    return {"flags": flags, "runs": runs, "one": one}


def _hits(runs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """uid, start, len, items: each occurrence of a window in a run. windows: a bounded block."""
    pieces = runs.selectExpr("uid", "s", "w", f"explode(sequence(0, greatest(size(w) - 1, 0), {PIECE})) AS c").selectExpr("uid", "s + c AS s", f"slice(w, c + 1, {PIECE + size - 1}) AS w")
    at = pieces.where("size(w) >= 2").selectExpr("uid", "s", "w", f"posexplode({SHINGLES}) AS (pos, shingle)")
    counts = at.groupBy("shingle").agg(F.count("*").alias("n"))
    prefix = (
        windows.where("size(w) >= 2")
        .selectExpr("w AS win", "items", f"posexplode({SHINGLES}) AS (off, shingle)")
        .join(counts, "shingle", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off")).alias("p"), F.first("items").alias("items"))
        .selectExpr("win", "items", "p.shingle AS shingle", "p.off AS off")
    )
    long = (
        at.join(F.broadcast(prefix), "shingle")
        .where("pos >= off AND pos - off + size(win) <= size(w)")
        .where("slice(w, pos - off + 1, size(win)) = win")
        .selectExpr("uid", "s + pos - off AS start", "size(win) AS len", "items")
    )
    single = windows.where("size(w) = 1").selectExpr("w[0] AS word", "items")
    short = pieces.selectExpr("uid", "s", "posexplode(w) AS (pos, word)").join(F.broadcast(single), "word").selectExpr("uid", "s + pos AS start", "1 AS len", "items")
    return long.unionByName(short)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """Per row of docs: uid, doc_id, n_words, n_hit, items (sorted array of item ids as strings).

    A null text has no words. Null ids stay null. Repeated rows and rows that share an id each get a result of their
    own. Items without words are no items; an item that occurs twice counts once per id. Columns of docs and benchmark
    beside doc_id, item_id and text are ignored. An empty benchmark hits nothing.
    """
    docs = docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    windows = written(item_windows(benchmark, size))
    # Bounded by the benchmark, not by the corpus.
    n = windows.agg(F.sum(F.size("w"))).first()[0] or 0
    n_blocks = max(1, -(-n // max_shingles))
    if n_blocks > 1:
        docs = written(docs)
    found = []
    counted = None
    for k in range(n_blocks):
        block = windows if n_blocks == 1 else windows.where(F.pmod(F.xxhash64("w"), F.lit(n_blocks)) == k)
        kinds = block.selectExpr("size(w) AS n", f"CASE WHEN size(w) >= 2 THEN {SHINGLES} END AS shingles", "CASE WHEN size(w) = 1 THEN w[0] END AS word")
        shingles = [r[0] for r in kinds.where("n >= 2").select(F.explode("shingles")).distinct().collect()]
        singles = [r[0] for r in kinds.where("n = 1").select("word").distinct().collect()]
        least = (kinds.where("n >= 2").agg(F.min("n")).first()[0] or 2) - 1
        cols = _runs(sorted(shingles), sorted(singles), least)
        held = (
            docs.select("uid", "doc_id", words(F.col("text")).alias("w"))
            .withColumn("flags", cols["flags"])
            .select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), cols["runs"].alias("runs"), cols["one"].alias("one"))
        )
        held = written(held)
        counted = counted if counted is not None else held.select("uid", "doc_id", "n_words")
        runs = held.select("uid", F.explode(F.concat("runs", "one")).alias("r")).select("uid", "r.s", "r.w")
        found.append(_hits(runs, block, size))
    hits = (
        reduce(DataFrame.unionByName, found)
        .groupBy("uid")
        .agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .selectExpr(
            "uid",
            "items",
            "cast(aggregate(at, named_struct('n', 0, 'end', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.start + x.len - greatest(x.start, a.end)), 'end', greatest(a.end, x.start + x.len))).n AS bigint) AS n_hit",
        )
    )
    return counted.join(hits, "uid", "left").select("uid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"))
