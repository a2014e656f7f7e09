"""Returns, rolling features and z-scores. Rolling windows count rows (traded days) and leave out the current one."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marketlens.functions.scalar import log_ratio

from .events import join_date_broadcast


def _by(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def _past(key: str, order: str, n: int) -> WindowSpec:
    return _by(key, order).rowsBetween(-n, -1)


def _finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def daily_returns(prices: DataFrame, key: str = "symbol", order: str = "trade_date", close: str = "close", adjusted: str | None = None, stored: str | None = None) -> DataFrame:
    """prices with r (simple) and lr (log): from a stored log return, else from adjusted closes, else from closes."""
    w = _by(key, order)

    def ratio(c: str) -> Column:
        return F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0.0))

    steps = [ratio(c) for c in (adjusted, close) if c]
    simple = F.coalesce(*[s - 1 for s in steps])
    logs = F.coalesce(*([F.col(stored)] if stored else []), *[F.when(s > 0, F.log(s)) for s in steps])
    return prices.withColumn("r", F.coalesce(F.exp(F.col(stored)) - 1, simple) if stored else simple).withColumn("lr", logs)


def cross_section_mean(returns: DataFrame, date_col: str = "trade_date", value: str = "r", min_n: int = 50) -> DataFrame:
    """Equal-weight mean per date, where at least min_n names have one."""
    return returns.groupBy(date_col).agg(F.avg(value).alias("market_mean"), F.count(value).alias("n")).where(F.col("n") >= min_n)


def abnormal_returns(returns: DataFrame, min_n: int = 50, date_col: str = "trade_date", mean_as: str | None = None) -> DataFrame:
    """returns with ar and alr: r and lr less their date's mean; null on dates of fewer than min_n names. mean_as: a column for r's mean.

    Means are a row per date, tens of thousands at most whatever the panel: aggregated first, then broadcast.
    """
    mean = returns.groupBy(date_col).agg(F.avg("r").alias("_m"), F.avg("lr").alias("_lm"), F.count("r").alias("_n"))
    out = returns.join(F.broadcast(mean), date_col, "left")
    ok = F.col("_n") >= min_n
    if mean_as:
        out = out.withColumn(mean_as, F.when(ok, F.col("_m")))
    return out.withColumn("ar", F.when(ok, F.col("r") - F.col("_m"))).withColumn("alr", F.when(ok, F.col("lr") - F.col("_lm"))).drop("_m", "_lm", "_n")


def industry_demean(returns: DataFrame, industry: str, value: str = "ar", min_n: int = 5, date_col: str = "trade_date") -> DataFrame:
    """returns with ind_ar: value less its (date, industry) mean where at least min_n names have one."""
    mean = returns.groupBy(date_col, industry).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    return returns.join(mean, [date_col, industry], "left").withColumn("ind_ar", F.when(F.col("_n") >= min_n, F.col(value) - F.col("_m"))).drop("_m", "_n")


def rolling_features(panel: DataFrame, n: int = 20, value: str = "ar", volume: str = "volume", key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """Sum and deviation of value and mean volume over the n rows before."""
    w = _past(key, order, n)
    return panel.withColumn("sum_n", F.sum(value).over(w)).withColumn("sigma_n", F.stddev_samp(value).over(w)).withColumn("volume_n", F.avg(volume).over(w))


def volume_ratio(panel: DataFrame, n: int = 20, volume: str = "volume", key: str = "symbol", order: str = "trade_date", *, pit: bool = False) -> DataFrame:
    """volume_ratio: today's volume over the mean of the n rows before; pit: yesterday's ratio, which is known before today."""
    ratio = F.col(volume) / F.nullif(F.avg(volume).over(_past(key, order, n)), F.lit(0.0))
    out = panel.withColumn("volume_ratio", ratio)
    return out.withColumn("volume_ratio", F.lag("volume_ratio").over(_by(key, order))) if pit else out


def lagged_levels(panel: DataFrame, cols: Sequence[str], far: int = 21, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """For each column: its level one row before, the change to that from `far` rows before, and the relative change."""
    w = _by(key, order)
    for c in cols:
        near, old = F.lag(c, 1).over(w), F.lag(c, far).over(w)
        panel = panel.withColumn(f"{c}_l1", near).withColumn(f"{c}_d", near - old).withColumn(f"{c}_rd", near / F.nullif(old, F.lit(0.0)) - 1)
    return panel


def rolling_beta(panel: DataFrame, y: str, x: str, n: int = 60, name: str = "beta", key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """Slope of y on x over the n rows before; pairs with a null don't count, no variance gives null."""
    return panel.withColumn(name, _finite(F.regr_slope(y, x).over(_past(key, order, n))))


def regime_level(market: DataFrame, n: int = 20, value: str = "market_mean", order: str = "trade_date") -> DataFrame:
    """Deviation of the market's return over the n rows before. A market is one row a date."""
    return market.withColumn("regime", F.stddev_samp(value).over(Window.orderBy(order).rowsBetween(-n, -1)))


def rolling_z(panel: DataFrame, col: str, n: int = 60, name: str | None = None, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """(value - mean) / deviation of the n rows before; null without a deviation."""
    w = _past(key, order, n)
    return panel.withColumn(name or f"{col}_z", (F.col(col) - F.avg(col).over(w)) / F.nullif(F.stddev_samp(col).over(w), F.lit(0.0)))


def series_z(series: DataFrame, n: int = 60, day: date | None = None, key: str = "series", order: str = "trade_date", value: str = "value") -> DataFrame:
    """z of each series on its last date before day (or on all dates, without a day)."""
    z = rolling_z(series, value, n, "z", key, order)
    if day is None:
        return z
    past = z.where(F.col(order) < F.lit(day))
    return past.groupBy(key).agg(F.max(order).alias(order), F.max_by("z", order).alias("z"))


def macro_z(series: DataFrame, day: date, n: int = 60, key: str = "series", order: str = "trade_date", value: str = "value") -> DataFrame:
    """series_z() on the last date before day, with top_mover: the series with the largest |z|."""
    z = series_z(series, n, day, key, order, value)
    top = z.agg(F.max_by(key, F.struct(F.abs("z"), F.col(key))).alias("_top"), F.max(F.abs("z")).alias("max_abs_z"))
    return z.join(F.broadcast(top)).withColumn("top_mover", F.col(key).eqNullSafe(F.col("_top"))).drop("_top")  # one row


def illiquidity(prices: DataFrame, turnover: str, key: str = "symbol", order: str = "trade_date", close: str = "close") -> DataFrame:
    """|simple return| over turnover, times 1e12."""
    prev = F.lag(close).over(_by(key, order))
    return prices.withColumn("illiquidity", F.abs(F.col(close) / F.nullif(prev, F.lit(0.0)) - 1) / F.nullif(F.col(turnover), F.lit(0.0)) * 1e12)


def nav_premium(nav: DataFrame, prices: DataFrame, key: str, order: str, close: str = "close") -> DataFrame:
    """nav ⋈ prices with premium (close / nav - 1) and nav_return."""
    out = nav.join(prices, [key, order])
    prev = F.lag("nav").over(_by(key, order))
    return out.withColumn("premium", F.col(close) / F.nullif(F.col("nav"), F.lit(0.0)) - 1).withColumn("nav_return", F.col("nav") / F.nullif(prev, F.lit(0.0)) - 1)


def sector_returns(index: DataFrame, key: str = "sector", order: str = "trade_date", value: str = "close") -> DataFrame:
    """Log return of each sector's index."""
    prev = F.lag(value).over(_by(key, order))
    return index.withColumn("sector_return", F.when((prev > 0) & (F.col(value) > 0), F.log(F.col(value) / prev)))


def fiscal_change(fin: DataFrame, cols: Sequence[str], as_of: date, key: str = "symbol", year: str = "fiscal_year", known: str = "available_from") -> DataFrame:
    """Change of each column on the fiscal year before, over rows known at as_of."""
    fin = fin.where(F.col(known) <= F.lit(as_of))
    for c in cols:
        fin = fin.withColumn(f"{c}_chg", F.col(c) / F.nullif(F.lag(c).over(_by(key, year)), F.lit(0.0)) - 1)
    return fin


def flow_cumulative(flows: DataFrame, w: int, key: Sequence[str], order: str, flow: str = "flow", turnover: str = "turnover") -> DataFrame:
    """Flow summed over the last w rows over the mean turnover of the same rows, with how many rows and flows there were."""
    span = Window.partitionBy(*key).orderBy(order).rowsBetween(-(w - 1), 0)
    return flows.withColumn("cum_flow", F.sum(flow).over(span) / F.nullif(F.avg(turnover).over(span), F.lit(0.0))).withColumn("n_rows", F.count(F.lit(1)).over(span)).withColumn("n_flows", F.count(flow).over(span))


def overnight_moves(indices: DataFrame, day: date, key: str = "symbol", order: str = "trade_date", close: str = "close") -> DataFrame:
    """Last two closes before day of each index, where its last date is the most recent one of all. move: log of the one over the other; infinite where one of them is 0."""
    past = indices.where(F.col(order) < F.lit(day)).withColumn("prev_close", F.lag(close).over(_by(key, order)))
    last = past.groupBy(key).agg(F.max(order).alias(order), F.max_by(close, order).alias("last_close"), F.max_by("prev_close", order).alias("prev_close"))
    newest = last.agg(F.max(order).alias("_newest"))
    return last.join(F.broadcast(newest)).where(F.col(order) == F.col("_newest")).drop("_newest").withColumn("move", log_ratio(F.col("last_close"), F.col("prev_close")))


def last_n_days(df: DataFrame, key: Sequence[str], order: str, n: int) -> DataFrame:
    """The trailing n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where(F.col("_n") <= n).drop("_n")


def feature_panel(prices: DataFrame, sectors: DataFrame, macro: DataFrame, min_n: int = 50, min_industry: int = 5, short: int = 5, long: int = 10) -> DataFrame:
    """The point-in-time panel: outcomes in three layers (r, ar, ind_ar) and exposures known the day before.

    prices: symbol, trade_date, close, volume; sectors: symbol, sector; macro: trade_date, macro (a row a date). Each row's
    exposures look at the rows before it only. Means by date are broadcast, so the rows shuffle by symbol, and once by
    (date, sector) if adaptive execution doesn't broadcast those means too.
    """
    out = abnormal_returns(daily_returns(prices), min_n, mean_as="market_r")
    out = industry_demean(out.join(sectors, "symbol", "left"), "sector", min_n=min_industry)
    out = join_date_broadcast(out, macro)
    out = rolling_features(out, short)
    out = volume_ratio(out, short, pit=True)
    out = lagged_levels(out, ["close"], far=short)
    out = rolling_beta(out, "r", "market_r", long, "beta_market")
    out = rolling_beta(out, "r", "macro", long, "beta_macro")
    return rolling_z(out, "r", long, "r_z")
