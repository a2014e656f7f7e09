"""Bars: roll-ups of finer bars, clock windows, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_bucket(ts: str | Column, minutes: int) -> Column:
    """The start of the bucket of so many minutes, counted from the epoch."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / (60 * minutes)) * (60 * minutes))


def ohlcv(order: str = "ts", o: str = "open", h: str = "high", lo: str = "low", c: str = "close", v: str = "volume") -> list[Column]:
    """The aggregates of a bar over finer ones: first and last go by time, not by arrival."""
    return [F.min_by(o, order).alias("open"), F.max(h).alias("high"), F.min(lo).alias("low"), F.max_by(c, order).alias("close"), F.sum(v).alias("volume")]


def rollup_bars(bars: DataFrame, minutes: int, closed_until: datetime | None = None, key: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Bars of so many minutes; only buckets that end by closed_until. available_at is the bucket's end."""
    end = F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")
    out = bars.withColumn("_b", floor_bucket(ts, minutes)).groupBy(*key, "_b").agg(*ohlcv(ts)).withColumnRenamed("_b", "ts").withColumn("available_at", end)
    return out if closed_until is None else out.where(F.col("available_at") <= F.lit(closed_until))


def rollup_session(bars: DataFrame, opens: datetime, closes: datetime, minutes: int, expected: int | None = None, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Bars on a grid that starts at the session's open; the last may be shorter. complete: every one of the expected units has its bar."""
    inside = bars.where((F.col(ts) >= F.lit(opens)) & (F.col(ts) < F.lit(closes)))
    step = 60 * minutes
    slot = F.floor((F.unix_seconds(ts) - F.unix_seconds(F.lit(opens))) / step)
    out = inside.withColumn("_slot", slot).groupBy(key, "_slot").agg(*ohlcv(ts))
    units = out.groupBy("_slot").agg(F.count("*").alias("_units"))
    start = F.timestamp_seconds(F.unix_seconds(F.lit(opens)) + F.col("_slot") * step)
    end = F.least(F.timestamp_seconds(F.unix_seconds(F.lit(opens)) + (F.col("_slot") + 1) * step), F.lit(closes))
    n = F.lit(expected) if expected is not None else F.max("_units").over(Window.partitionBy(F.lit(1)))
    units = units.withColumn("complete", F.col("_units") >= n)  # a row for each slot of the session
    return out.join(units, "_slot").withColumn("ts", start).withColumn("available_at", end).drop("_slot", "_units")


def rollup_daily(bars: DataFrame, volume_trusted_from: date | None = None, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Daily bars with simple_return and log_return on the previous traded day. Volumes before the trusted date are null."""
    day = bars.withColumn("trade_date", F.to_date(ts)).groupBy(key, "trade_date").agg(*ohlcv(ts))
    if volume_trusted_from is not None:
        day = day.withColumn("volume", F.when(F.col("trade_date") >= F.lit(volume_trusted_from), F.col("volume")))
    before = F.lag("close").over(Window.partitionBy(key).orderBy("trade_date"))
    return day.withColumn("_p", before).withColumn("simple_return", F.col("close") / F.nullif("_p", F.lit(0.0)) - 1).withColumn("log_return", F.when((F.col("_p") > 0) & (F.col("close") > 0), F.log(F.col("close") / F.col("_p")))).drop("_p")


def slice_clock(bars: DataFrame, day: date, start: str, end: str, day_col: str = "trade_date", ts: str = "ts") -> DataFrame:
    """A day's bars with start <= clock time < end (as HH:mm:ss)."""
    clock = F.date_format(ts, "HH:mm:ss")
    return bars.where((F.col(day_col) == F.lit(day)) & (clock >= start) & (clock < end))


def clock_return(bars: DataFrame, day: date, start: str, end: str, key: str = "symbol", day_col: str = "trade_date", ts: str = "ts") -> DataFrame:
    """Log of the last close over the first open in a clock window, and the volume, per symbol."""
    return slice_clock(bars, day, start, end, day_col, ts).groupBy(key).agg(F.log(F.try_divide(F.max_by("close", ts), F.min_by("open", ts))).alias("clock_return"), F.sum("volume").alias("volume"))


def slice_requested_window(bars: DataFrame, start: datetime, end: datetime, minutes: int, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Bars that cover [start, end) exactly on the clock's grid: the first and the last may be parts of a bucket."""
    inside = bars.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    return inside.withColumn("_b", F.greatest(floor_bucket(ts, minutes), F.lit(start))).groupBy(key, "_b").agg(*ohlcv(ts)).withColumnRenamed("_b", "ts")


def gap_return(bars: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Per day: log of the first open over the previous day's last close."""
    day = bars.groupBy(key, F.to_date(ts).alias("trade_date")).agg(F.min_by("open", ts).alias("day_open"), F.max_by("close", ts).alias("day_close"))
    prev = F.lag("day_close").over(Window.partitionBy(key).orderBy("trade_date"))
    return day.withColumn("prev_close", prev).withColumn("gap", F.log(F.try_divide("day_open", "prev_close")))


def window_return(bars: DataFrame, windows: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Per symbol and window (window_id, w_start, w_end; a bounded list): log return, bar count. A window without bars of a symbol that has any is null with count 0."""
    day = F.to_date("w_start")
    spans = windows.select("window_id", "w_start", "w_end", day.alias("_d"))
    inside = bars.withColumn("_d", F.to_date(ts)).join(spans, "_d").where((F.col(ts) >= F.col("w_start")) & (F.col(ts) < F.col("w_end")))
    found = inside.groupBy(key, "window_id").agg(F.log(F.try_divide(F.max_by("close", ts), F.min_by("open", ts))).alias("window_return"), F.count("*").alias("n_bars"))
    grid = bars.withColumn("_d", F.to_date(ts)).select(key, "_d").distinct().join(spans, "_d").select(key, "window_id")
    return grid.join(found, [key, "window_id"], "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0).cast("long")))


def bars_per_day_histogram(bars: DataFrame, key: str = "symbol", day_col: str = "trade_date") -> DataFrame:
    """How many symbol-days have so many bars; is_mode: the most frequent number (of equals, the larger)."""
    hist = bars.groupBy(key, day_col).agg(F.count("*").alias("n_bars")).groupBy("n_bars").agg(F.count("*").alias("symbol_days"))
    mode = hist.agg(F.max(F.struct("symbol_days", "n_bars")).alias("m")).select(F.col("m.n_bars").alias("_mode"))
    # One row; the histogram has a row for each count.
    return hist.join(F.broadcast(mode)).withColumn("is_mode", F.col("n_bars") == F.col("_mode")).drop("_mode")


def window_coverage(bars: DataFrame, universe: DataFrame, start: datetime, end: datetime, weight: str = "weight", key: str = "symbol", ts: str = "ts") -> DataFrame:
    """One row: expected and observed unit-minutes of [start, end), complete units, least coverage of a unit, weight share of complete ones."""
    minutes = int((end - start).total_seconds() // 60)
    seen = bars.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))).groupBy(key).agg(F.countDistinct(F.date_trunc("minute", ts)).alias("_n"))
    unit = universe.join(seen, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
    full = F.col("_n") >= minutes
    return unit.agg(
        (F.count("*") * minutes).alias("expected"), F.sum("_n").alias("observed"), F.count_if(full).alias("complete_units"), F.min(F.col("_n") / minutes).alias("min_coverage"), (F.coalesce(F.sum(F.when(full, F.col(weight))), F.lit(0.0)) / F.sum(weight)).alias("weight_coverage")
    )


def path_returns(bars: DataFrame, units: Sequence[str] | Sequence[int], key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Log returns bar by bar on the times that all units have; the first bar's is from its open."""
    own = bars.where(F.col(key).isin(list(units)))
    common = own.groupBy(ts).agg(F.countDistinct(key).alias("_n")).where(F.col("_n") == len(set(units))).select(ts)
    prev = F.lag("close").over(Window.partitionBy(key).orderBy(ts))
    return own.join(common, ts, "left_semi").withColumn("path_return", F.log(F.try_divide("close", F.coalesce(prev, F.col("open")))))


def slot_differences(slots: DataFrame, key: Sequence[str], slot: str, value: str) -> DataFrame:
    """Cumulative values by slot as values of each slot."""
    return slots.withColumn("slot_value", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*key).orderBy(slot)), F.lit(0)))


def dedup_bars(bars: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One bar for each key: the last by order."""
    return bars.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def reconcile_sources(daily: DataFrame, bars: DataFrame, tolerance: float = 1e-9, key: str = "symbol", day_col: str = "trade_date", ts: str = "ts") -> DataFrame:
    """Per day: symbols in both, those whose daily close isn't the last bar's, and whether the check failed (no symbol joined, or any mismatch)."""
    last = bars.groupBy(key, day_col).agg(F.max_by("close", ts).alias("_last"))
    both = daily.select(key, day_col, "close").join(last, [key, day_col], "left")
    off = F.col("_last").isNotNull() & (F.abs(F.col("close") - F.col("_last")) > tolerance)
    out = both.groupBy(day_col).agg(F.count("_last").alias("joined"), F.count_if(off).alias("mismatched"))
    return out.withColumn("failed", (F.col("joined") == 0) | (F.col("mismatched") > 0))


def sector_proxy(bars: DataFrame, members: DataFrame, daily_index: DataFrame, topn: int = 5, min_corr: float = 0.2, ts: str = "ts") -> DataFrame:
    """Per sector and time: the mean return of its topn members by weight, kept where its daily sums correlate with the sector's index (sector, trade_date, index_return). members: symbol, sector, weight."""
    rank = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("weight"), "symbol"))
    top = members.withColumn("_r", rank).where(F.col("_r") <= topn).select("symbol", "sector")
    proxy = bars.join(top, "symbol").groupBy("sector", ts).agg(F.avg("ret").alias("proxy_return"), F.count("*").alias("n"))
    daily = proxy.groupBy("sector", F.to_date(ts).alias("trade_date")).agg(F.sum("proxy_return").alias("_s"))
    gate = daily.join(daily_index, ["sector", "trade_date"]).groupBy("sector").agg(F.corr("_s", "index_return").alias("correlation")).where(F.col("correlation") >= min_corr)
    return proxy.join(gate, "sector")
