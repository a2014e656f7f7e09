"""The minute lane: bars, triggers, news and threads as streams, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlens.functions.scalar import stable_id
from marketlens.operators.bars import ohlcv


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, into Parquet, with its checkpoint beside it; a rerun goes on from there."""
    stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def stream_bars(spark: SparkSession, path: str, schema: str, watermark: str, key: Sequence[str] = ("symbol", "ts"), ts: str = "ts") -> DataFrame:
    """Minute bars from a folder of files; a bar that comes twice within the watermark counts once."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(key))


def stream_tumbling_ohlcv(bars: DataFrame, minutes: int, watermark: str | None = None, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Bars of so many minutes, emitted once closed: when the watermark has passed a bucket's end. The same on a batch, all of them."""
    if watermark is not None:
        bars = bars.withWatermark(ts, watermark)
    out = bars.groupBy(key, F.window(ts, f"{minutes} minutes").alias("w")).agg(*ohlcv(ts))
    return out.select(key, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", F.col("w.end").alias("available_at"))


#: Parts of a universe that windows meet one by one.
BLOCKS = 64


def classify_units(batch: DataFrame, universe: DataFrame, windows: DataFrame, unit: str = "symbol", window: str = "ts") -> DataFrame:
    """Per window and expected unit: received, no_trade (flat, no volume), invalid (no OHLC that fits), or missing. Every window meets every unit, as missing ones are found so; units are dealt in BLOCKS, so either list may be large."""
    own = universe.select(unit).distinct().withColumn("_block", F.pmod(F.xxhash64(unit), F.lit(BLOCKS)).cast("int"))
    grid = windows.select(window).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).join(own, "_block").drop("_block")
    j = grid.join(batch, [unit, window], "left")
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0)
    flat = (F.col("volume") == 0) & (F.col("open") == F.col("close")) & (F.col("high") == F.col("low"))
    return j.select(window, unit, F.when(F.col("close").isNull(), "missing").when(bad, "invalid").when(flat, "no_trade").otherwise("received").alias("status"))


def session_open_fallback(bars: DataFrame, baselines: DataFrame, key: Sequence[str] = ("session", "symbol"), ts: str = "ts") -> DataFrame:
    """Base price of each unit's session: the close before, else the first window's open."""
    first = bars.groupBy(*key).agg(F.min_by("open", ts).alias("_open"))
    j = first.join(baselines.select("symbol", "prev_close"), "symbol", "left")
    return j.select(*key, F.coalesce("prev_close", "_open").alias("base"), F.when(F.col("prev_close").isNotNull(), "PREV_CLOSE").otherwise("SESSION_OPEN").alias("base_kind"))


REVERT, FIRE = 0.01, 0.03


def price_trigger(bars: DataFrame, baselines: DataFrame, revert: float = REVERT, fire: float = FIRE, key: Sequence[str] = ("session", "symbol"), ts: str = "ts") -> DataFrame:
    """Batch: each unit's windows in order. Within `revert` of the base after a move: REVERT, and the anchor is the base
    again. Else `fire` or more away from the anchor: FIRE, and the anchor moves there. Bars without a positive close or base
    are no prices: they are passed over. A session has a bounded number of windows."""
    rows = bars.where(F.col("close") > 0).join(baselines.where(F.col("base") > 0), list(key)).groupBy(*key, "base").agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col("close").alias("c")))).alias("l"))
    kind = dict(bars.dtypes)[ts]
    fold = f"""aggregate(l, named_struct('anchor', base, 'out', cast(array() AS array<struct<t: {kind}, close: double, event: string, anchor: double>>)),
        (a, x) -> IF(abs(x.c / base - 1) <= {revert}D,
            IF(a.anchor = base, a, named_struct('anchor', base, 'out', array_append(a.out, named_struct('t', x.t, 'close', x.c, 'event', 'REVERT', 'anchor', base)))),
            IF(abs(x.c / a.anchor - 1) >= {fire}D, named_struct('anchor', x.c, 'out', array_append(a.out, named_struct('t', x.t, 'close', x.c, 'event', 'FIRE', 'anchor', x.c))), a)), a -> a.out)"""
    return rows.select(*key, F.explode(F.expr(fold)).alias("x")).select(*key, F.col("x.t").alias(ts), "x.close", "x.event", "x.anchor")


#: Groups that the units of a session go in, for their state.
GROUPS = 256


def stream_price_trigger(bars: DataFrame, revert: float = REVERT, fire: float = FIRE, key: Sequence[str] = ("session", "symbol"), ts: str = "ts") -> DataFrame:
    """The same on a stream of bars with their base (column base). State is the anchor and its window; windows no later than the last one seen never fire, nor do those without a positive close or base.

    A call for a key costs far more than its rows, so keys of one first column go in GROUPS, by hash of the whole key. A group's
    state has the anchors and windows of its keys, in the order of the keys, and its keys are stepped through at once: the
    first rows of all, then the second ones.
    """
    kinds = dict(bars.dtypes)
    out = ", ".join([*(f"{k} {kinds[k]}" for k in key), f"{ts} {kinds[ts]}", "close double", "event string", "anchor double"])
    by = [key[0], "_group"]
    names = [*key, ts, "close", "base"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        close, base = rows["close"].to_numpy(float), rows["base"].to_numpy(float)
        with np.errstate(invalid="ignore"):
            rows = rows[(base > 0) & (close > 0)]
        held = pd.DataFrame(dict(zip((*key[1:], "_anchor", "_seen"), map(list, state.get), strict=True)) if state.exists else {}, columns=[*key[1:], "_anchor", "_seen"])
        at = rows[ts].to_numpy("datetime64[ns]").astype(np.int64)
        units = pd.concat([held[list(key[1:])], rows[list(key[1:])]], ignore_index=True).astype({c: rows[c].dtype for c in key[1:]})
        unit = units.groupby(list(key[1:]), sort=False, dropna=False).ngroup().to_numpy()
        n = int(unit.max()) + 1 if len(unit) else 0
        anchor, seen = np.full(n, np.nan), np.full(n, -(2**63), np.int64)
        known, own = unit[: len(held)], unit[len(held) :]
        anchor[known], seen[known] = held["_anchor"].to_numpy(float), held["_seen"].to_numpy(np.int64)
        order = np.lexsort((np.arange(len(at)), at, own))
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        rounds = np.argsort(nth, kind="stable")
        close, base = rows["close"].to_numpy(float), rows["base"].to_numpy(float)
        event, moved = np.zeros(len(rows), np.int8), np.empty(len(rows))
        for now in np.split(order[rounds], np.flatnonzero(np.diff(nth[rounds])) + 1):
            now = now[at[now] > seen[own[now]]]
            u, c, b = own[now], close[now], base[now]
            seen[u] = at[now]
            a = np.where(np.isnan(anchor[u]), b, anchor[u])
            near = np.abs(c / b - 1) <= revert
            far = ~near & (np.abs(c / a - 1) >= fire)
            event[now] = np.where(near & (a != b), 1, np.where(far, 2, 0))
            anchor[u] = np.where(near, b, np.where(far, c, a))
            moved[now] = anchor[u]
        if n:
            first = units[~pd.Series(unit).duplicated()]  # units go by their first rows
            state.update((*(first[c].tolist() for c in key[1:]), anchor.tolist(), seen.tolist()))
        told = order[event[order] > 0]
        found = rows.iloc[told][[*key, ts, "close"]].copy()
        found["event"], found["anchor"] = np.where(event[told] == 1, "REVERT", "FIRE"), moved[told]
        yield found

    grouped = bars.select(*names).withColumn("_group", F.pmod(F.xxhash64(*key), F.lit(GROUPS)).cast("int"))
    kept = ", ".join([*(f"{c} array<{kinds[c]}>" for c in key[1:]), "anchor array<double>", "seen array<long>"])
    return grouped.groupBy(*by).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def idempotent_fire(fires: DataFrame, target: DataFrame | None = None, key: Sequence[str] = ("session", "symbol", "ts")) -> DataFrame:
    """Fires with an id that follows from their key, once each, without those that target has."""
    out = fires.withColumn("trigger_id", stable_id("trg_", *[F.col(c) for c in key])).dropDuplicates(["trigger_id"])
    return out if target is None else out.join(target.select("trigger_id"), "trigger_id", "left_anti")


def news_observe(items: DataFrame, key: str = "item_id", content: str = "hash", seen: str = "seen", url: str = "url_id", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Batch: observation, promoted, generation and article_id of each observation of an item, in order; see stateful.observe().

    An address counts from its first observation on, whatever else that one is, so conflicts follow from it alone; the other
    outcomes follow from the observations without a conflict.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    out = items.withColumn("_known", F.first(url, ignorenulls=True).over(before)).withColumn("_nth", F.row_number().over(w))
    clash = F.col(url).isNotNull() & F.col("_known").isNotNull() & (F.col(url) != F.col("_known"))
    out = out.withColumn("_clash", clash).withColumn("promoted", F.col(url).isNotNull() & F.col("_known").isNull() & (F.col("_nth") > 1))
    out = out.withColumn("_newest", F.max(F.when(~F.col("_clash"), F.col(seen))).over(before))
    # What is accepted last: of the newest observations the first, as others of that moment have the same content or conflict.
    own = Window.partitionBy(key, "_clash", seen).orderBy(*order)
    out = out.withColumn("_first", F.first(content).over(own)).withColumn("_last", F.max_by("_first", F.when(~F.col("_clash"), F.col(seen))).over(before))
    changed = ~F.col(content).eqNullSafe(F.col("_last"))
    what = (
        F.when(F.col("_nth") == 1, "NEW")
        .when(F.col("_clash"), "IDENTITY_CONFLICT")
        .when(F.col(seen) < F.col("_newest"), "STALE")
        .when(changed & (F.col(seen) == F.col("_newest")), "CHECKSUM_CONFLICT")
        .when(changed, "CONTENT_CHANGED")
        .when(F.col("promoted"), "ID_PROMOTED")
        .otherwise("UNCHANGED")
    )
    out = out.withColumn("observation", what)
    out = out.withColumn("generation", F.sum(F.col("observation").isin("NEW", "CONTENT_CHANGED").cast("int")).over(upto).cast("int"))
    article = F.coalesce("_known", F.col(url), F.concat(F.lit("item:"), F.col(key).cast("string")))
    return out.withColumn("article_id", article).drop("_known", "_nth", "_clash", "_newest", "_first", "_last")


def overlap_poll_dedup(pages: DataFrame, anchors: DataFrame, key: str = "item_id", content: str = "hash", page: str = "page") -> DataFrame:
    """Items of overlapping pages up to the anchor's page: one row each; items that come with two contents are CONFLICT."""
    stop = pages.join(anchors, key, "left_semi").agg(F.min(page).alias("_stop"))
    upto = pages.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop")))  # one row
    return upto.groupBy(key).agg(F.countDistinct(content).alias("_n"), F.min(page).alias("first_page"), F.min(content).alias(content), F.bool_or(F.col("_stop").isNull()).alias("truncated")).withColumn("state", F.when(F.col("_n") > 1, "CONFLICT").otherwise("OK")).drop("_n")


def revert_exposure(reverts: DataFrame, results: DataFrame, unit: str = "symbol", ts: str = "ts") -> DataFrame:
    """Results with status WITHDRAWN where a later revert of their unit came in."""
    last = reverts.groupBy(unit).agg(F.max(ts).alias("_reverted"))
    return results.join(last, unit, "left").withColumn("status", F.when((F.col("status") == "PUBLISHED") & (F.col("_reverted") >= F.col(ts)), "WITHDRAWN").otherwise(F.col("status"))).drop("_reverted")


def nav_minute(rows: DataFrame, window: datetime, label: str = "label", value: str = "nav") -> DataFrame:
    """The NAV rows whose label is exactly a window's."""
    return rows.where(F.col(label) == F.lit(window.strftime("%H%M"))).withColumn(value, F.col(value).cast("decimal(24,8)"))


def each_batch(stream: DataFrame, path: str, f: Callable[[DataFrame, int], None]) -> None:
    """Runs f on each micro-batch of what is there now; batches come again after a failure, so f must be idempotent."""
    stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
