"""Point-in-time reads and as-of joins: nothing that was not known, or had not happened, at the moment asked about."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.sink import written

#: Rows from which a key may be cut into SEGMENTS in as-of joins; no more than HOT_KEYS are.
HOT, SEGMENTS, HOT_KEYS = 1_000_000, 64, 10_000
#: Columns that date a row, the strictest first.
CLAMP_COLUMNS = ("available_at", "fetched_at", "published_at", "trade_date", "as_of_date", "ts", "event_date")


def clamp_column(df: DataFrame, columns: Sequence[str] = CLAMP_COLUMNS) -> str | None:
    """The first of the clamp columns that df has."""
    return next((c for c in columns if c in df.columns), None)


def clamp_as_of(df: DataFrame, as_of: datetime, day: date | None = None, columns: Sequence[str] = CLAMP_COLUMNS) -> DataFrame:
    """Rows known at as_of: an instant column is cut at as_of, a date column at day. A table with no such column is an error."""
    name = clamp_column(df, columns)
    if name is None:
        raise ValueError("no column says when these rows were known")
    if dict(df.dtypes)[name] == "date":
        return df.where(F.col(name) <= F.lit(day or as_of.date()))
    return df.where(F.col(name) <= F.lit(as_of))


def bars_as_of(bars: DataFrame, day: date, as_of: datetime, day_col: str = "trade_date", known: str = "available_at") -> DataFrame:
    """A day's bars that were known at an instant; the day prunes partitions."""
    return bars.where((F.col(day_col) == F.lit(day)) & (F.col(known) <= F.lit(as_of)))


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key by order (names: descending)."""
    by = [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in order]
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_nth = 1").drop("_nth")


def as_of_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], known: str, as_of: datetime | date) -> DataFrame:
    """The last row of each key among those known at as_of."""
    return latest_by_key(df.where(F.col(known) <= F.lit(as_of)), key, order)


def _segments(both: DataFrame, keys: Sequence[str], hot: int) -> DataFrame | None:
    """Keys, _bounds: times that cut the rows of each hot key into some SEGMENTS; None without any. Hot: more than `hot` rows, and more than one of HOT_KEYS of all, so they are HOT_KEYS at most."""
    counts = written(both.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_n")))
    least = max(hot, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT_KEYS)
    many = counts.where(F.col("_n") > least).drop("_n")
    if not many.limit(1).count():
        return None
    grid = [k / SEGMENTS for k in range(1, SEGMENTS)]
    return written(both.select(*keys, "_t").join(F.broadcast(many), list(keys)).groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_t", grid)).alias("_bounds")))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, take: Sequence[str], *, exact: bool = True, forward: bool = False, hot: int = HOT) -> DataFrame:
    """left with `take` of the latest right row at or before left_on (forward: the first at or after); left outer.

    One shuffle by key: both sides in one frame, ordered by time, the last right row carried along. With exact=False a
    right row of the same time doesn't count. Of right rows with equal key and time, the largest `take` counts (forward:
    the smallest). Null keys match nothing.

    A key with very many rows is cut into segments of time, a task each; the last right row of each segment (forward: the
    first) is carried into those after it (before it).
    """
    left_cols = left.columns
    mine = F.struct(*[F.col(c) for c in left_cols])
    # Right rows come before left ones of the same time if they count for them (in walking order), else after.
    tag_right = (0 if exact else 2) if not forward else (2 if exact else 0)
    a = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(left_on).alias("_t"), F.lit(1).alias("_tag"), mine.alias("_left"))
    b = right.where(F.col(right_on).isNotNull()).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(right_on).alias("_t"), F.lit(tag_right).alias("_tag"), F.struct(*take).alias("_right"))
    keys = [f"_k{i}" for i in range(len(by))]
    both = a.unionByName(b, allowMissingColumns=True)
    bounds = _segments(both.select(*keys, "_t"), keys, hot)
    # Rows with a null key match nothing: they are dealt to many tasks.
    spread = F.when(F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull(), F.pmod(F.xxhash64("_t", "_left", "_right"), F.lit(1024))).otherwise(0)
    both = both.withColumn("_spread", spread)
    place = [*keys, "_spread"]
    if bounds is not None:
        segment = F.coalesce(F.size(F.filter("_bounds", lambda x: x <= F.col("_t"))), F.lit(0))
        cut = lambda df: df.join(F.broadcast(bounds), keys, "left").withColumn("_seg", F.when(F.col("_bounds").isNull(), 0).otherwise(segment))
        both, place = cut(both).drop("_bounds"), [*place, "_seg"]
    order = Window.partitionBy(*place).orderBy("_t", "_tag", "_right")
    if forward:
        found = F.first("_right", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_found", found)
    if bounds is not None:
        out = out.join(_carried(cut(b).where("_bounds IS NOT NULL"), keys, forward), place, "left").withColumn("_found", F.coalesce("_found", "_carry"))
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return out.withColumn("_found", F.when(ok & F.col("_t").isNotNull(), F.col("_found"))).where("_left IS NOT NULL").select("_left.*", *[F.col("_found")[c].alias(c) for c in take])


def _carried(b: DataFrame, keys: Sequence[str], forward: bool) -> DataFrame:
    """keys, _spread, _seg, _carry: what comes into each segment of a hot key: the last right row of the segments before it (forward: the first of those after it). SEGMENTS rows a hot key."""
    edge = F.struct("_t", "_right")
    own = b.groupBy(*keys, "_seg").agg((F.min_by("_right", edge) if forward else F.max_by("_right", edge)).alias("_carry"))
    w = Window.partitionBy(*keys).orderBy("_seg")
    if forward:
        reach = F.sequence(F.coalesce(F.lag("_seg").over(w), F.lit(0)), F.col("_seg") - 1)
        own = own.where("_seg > 0")
    else:
        reach = F.sequence(F.col("_seg") + 1, F.coalesce(F.lead("_seg").over(w), F.lit(SEGMENTS)))
        own = own.where(F.col("_seg") < SEGMENTS)
    return own.withColumn("_reach", reach).select(*keys, F.lit(0).cast("long").alias("_spread"), F.explode("_reach").alias("_seg"), "_carry")


def asof_join_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, take: Sequence[str], allow_exact: bool = True) -> DataFrame:
    return asof_join(left, right, by, left_on, right_on, take, exact=allow_exact)


def asof_join_forward(left: DataFrame, calendar: DataFrame, by: Sequence[str], left_on: str, right_on: str, name: str) -> DataFrame:
    """left with name: the first calendar day of its key at or after left_on."""
    return asof_join(left, calendar.withColumn(name, F.col(right_on)), by, left_on, right_on, [name], forward=True)


def asof_join_cross_calendar(left: DataFrame, right: DataFrame, left_on: str, right_on: str, take: Sequence[str]) -> DataFrame:
    """Each left date with the last right session strictly before it.

    A calendar is one row a session, so both sides are reduced to distinct dates first; rows of left then join by equality.
    """
    one = F.lit(1).alias("_one")
    days = asof_join(left.select(left_on).distinct().withColumn("_one", one), right.withColumn("_one", one), ["_one"], left_on, right_on, take, exact=False)
    return left.join(days.drop("_one"), left_on, "left")


def snapshot_as_of(df: DataFrame, group: Sequence[str], as_of_col: str, day: date) -> DataFrame:
    """All rows of each group's latest snapshot at or before day."""
    last = df.where(F.col(as_of_col) <= F.lit(day)).groupBy(*group).agg(F.max(as_of_col).alias(as_of_col))
    return df.join(last, [*group, as_of_col], "left_semi")


def snapshot_as_of_or_next(df: DataFrame, group: Sequence[str], as_of_col: str, day: date) -> DataFrame:
    """As snapshot_as_of(); a group without one gets its earliest later snapshot, with is_future true."""
    c = F.col(as_of_col)
    chosen = df.groupBy(*group).agg(F.max(F.when(c <= F.lit(day), c)).alias("_past"), F.min(F.when(c > F.lit(day), c)).alias("_next"))
    chosen = chosen.select(*group, F.coalesce("_past", "_next").alias(as_of_col), F.col("_past").isNull().alias("is_future"))
    return df.join(chosen, [*group, as_of_col])


def snapshot_skip_sparse(df: DataFrame, group: Sequence[str], as_of_col: str, value: str, day: date, min_share: float = 0.5) -> DataFrame:
    """As snapshot_as_of(), passing over snapshots of which less than min_share have a value."""
    full = df.where(F.col(as_of_col) <= F.lit(day)).groupBy(*group, as_of_col).agg(F.avg(F.col(value).isNotNull().cast("int")).alias("_share")).where(F.col("_share") >= min_share)
    return df.join(full.groupBy(*group).agg(F.max(as_of_col).alias(as_of_col)), [*group, as_of_col], "left_semi")


def prev_close_bounded(bars: DataFrame, wanted: DataFrame, day: date, lookbacks: Sequence[int] = (10, 40, 400), symbol: str = "symbol", date_col: str = "trade_date", close: str = "close", ts: str = "ts") -> DataFrame:
    """symbol, prev_date, prev_close before day for the symbols of wanted; look-backs widen for those not found yet only."""
    left, out = wanted.select(symbol).distinct(), None
    for days in lookbacks:
        span = bars.where((F.col(date_col) < F.lit(day)) & (F.col(date_col) >= F.date_sub(F.lit(day), days)))
        found = span.join(left, symbol, "left_semi").groupBy(symbol).agg(F.max_by(date_col, ts).alias("prev_date"), F.max_by(close, ts).alias("prev_close"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found, symbol, "left_anti")
    return out


def prev_close_baseline(prices: DataFrame, session: date, key: Sequence[str] = ("symbol",), date_col: str = "trade_date", close: str = "close") -> DataFrame:
    """The close of each key's last day before a session."""
    before = prices.where(F.col(date_col) < F.lit(session))
    return before.groupBy(*key).agg(F.max(date_col).alias("prev_date"), F.max_by(close, date_col).alias("prev_close"))


def timestamp_sidecar(previous: DataFrame, batch: DataFrame, key: str, ts: str) -> DataFrame:
    """The earliest time known for each key, over what was kept before and a batch; midnights, which stand for no time, don't count."""
    both = previous.select(key, ts).unionByName(batch.select(key, ts))
    return both.where(F.date_format(ts, "HH:mm:ss") != "00:00:00").groupBy(key).agg(F.min(ts).alias(ts))
