"""Returns, rolling features and z-scores over daily prices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import panel as P
from marketlens.registry import query

from .bindings import DAY, MIN_N, PRICES, RETURNS, SECTORS, prices, returns, sectors, t

D = f"DATE '{DAY}'"


def _r(df, *cols, n=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


@query("daily_returns", f"WITH {RETURNS} SELECT symbol, trade_date, round(r, 9) AS r, round(lr, 9) AS lr FROM returns")
def _(spark, sf):
    return _r(P.daily_returns(prices(spark, sf)).select("symbol", "trade_date", "r", "lr"), "r", "lr", n=9)


@query("cross_section_mean", f"WITH {RETURNS} SELECT trade_date, round(market_mean, 6) AS market_mean, n FROM market WHERE n >= {MIN_N}")
def _(spark, sf):
    return _r(P.cross_section_mean(P.daily_returns(prices(spark, sf)), min_n=MIN_N), "market_mean")


@query("abnormal_returns", f"WITH {RETURNS} SELECT symbol, trade_date, round(ar, 6) AS ar, round(alr, 6) AS alr FROM abnormal")
def _(spark, sf):
    return _r(returns(spark, sf).select("symbol", "trade_date", "ar", "alr"), "ar", "alr")


@query(
    "industry_demean",
    f"""WITH {RETURNS}, {SECTORS}, m AS (SELECT a.*, sector FROM abnormal a LEFT JOIN sectors USING (symbol))
    SELECT symbol, trade_date, CASE WHEN count(ar) OVER w >= 5 THEN round(ar - avg(ar) OVER w, 6) END AS ind_ar FROM m WINDOW w AS (PARTITION BY trade_date, sector)""",
)
def _(spark, sf):
    return _r(P.industry_demean(returns(spark, sf).join(sectors(spark, sf), "symbol", "left"), "sector").select("symbol", "trade_date", "ind_ar"), "ind_ar")


_W = "PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {} PRECEDING AND 1 PRECEDING"


@query("rolling_features", f"WITH {RETURNS} SELECT symbol, trade_date, round(sum(ar) OVER w, 6) AS sum_n, round(stddev_samp(ar) OVER w, 6) AS sigma_n, round(avg(volume) OVER w, 6) AS volume_n FROM abnormal WINDOW w AS ({_W.format(5)})")
def _(spark, sf):
    return _r(P.rolling_features(returns(spark, sf), 5).select("symbol", "trade_date", "sum_n", "sigma_n", "volume_n"), "sum_n", "sigma_n", "volume_n")


@query("volume_ratio", f"WITH {PRICES} SELECT symbol, trade_date, round(volume / nullif(avg(volume) OVER w, 0), 6) AS volume_ratio FROM prices WINDOW w AS ({_W.format(5)})")
def _(spark, sf):
    return _r(P.volume_ratio(prices(spark, sf), 5).select("symbol", "trade_date", "volume_ratio"), "volume_ratio")


@query("volume_ratio_pit", f"WITH {PRICES}, v AS (SELECT symbol, trade_date, volume / nullif(avg(volume) OVER w, 0) AS x FROM prices WINDOW w AS ({_W.format(5)})) SELECT symbol, trade_date, round(lag(x) OVER (PARTITION BY symbol ORDER BY trade_date), 6) AS volume_ratio FROM v")
def _(spark, sf):
    return _r(P.volume_ratio(prices(spark, sf), 5, pit=True).select("symbol", "trade_date", "volume_ratio"), "volume_ratio")


@query(
    "lagged_levels",
    f"""WITH {PRICES} SELECT symbol, trade_date, lag(close) OVER w AS close_l1, round(lag(close) OVER w - lag(close, 5) OVER w, 6) AS close_d, round(lag(close) OVER w / nullif(lag(close, 5) OVER w, 0) - 1, 6) AS close_rd
    FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""",
)
def _(spark, sf):
    return _r(P.lagged_levels(prices(spark, sf), ["close"], 5).select("symbol", "trade_date", "close_l1", "close_d", "close_rd"), "close_d", "close_rd")


@query(
    "rolling_beta",
    f"""WITH {RETURNS}, j AS (SELECT symbol, trade_date, r, market_mean AS m FROM returns LEFT JOIN market USING (trade_date)),
    b AS (SELECT symbol, trade_date, regr_slope(r, m) OVER w AS b, count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER w AS n FROM j WINDOW w AS ({_W.format(10)}))
    SELECT symbol, trade_date, CASE WHEN n >= 3 AND isfinite(b) THEN round(b, 4) + 0.0 END AS beta FROM b""",
)
def _(spark, sf):
    r = P.daily_returns(prices(spark, sf))
    m = P.cross_section_mean(r, min_n=1).select("trade_date", F.col("market_mean").alias("m"))
    from pyspark.sql import Window

    j = r.join(m, "trade_date", "left")
    n = F.count(F.when(F.col("r").isNotNull() & F.col("m").isNotNull(), 1)).over(Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-10, -1))
    return P.rolling_beta(j, "r", "m", 10).withColumn("beta", F.when(n >= 3, F.round("beta", 4) + 0.0)).select("symbol", "trade_date", "beta")


@query("regime_level", f"WITH {RETURNS} SELECT trade_date, round(stddev_samp(market_mean) OVER (ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS regime FROM market WHERE n >= {MIN_N}")
def _(spark, sf):
    return _r(P.regime_level(P.cross_section_mean(P.daily_returns(prices(spark, sf)), min_n=MIN_N), 5).select("trade_date", "regime"), "regime")


@query("rolling_z", f"WITH {RETURNS} SELECT symbol, trade_date, round((r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0), 4) AS r_z FROM returns WINDOW w AS ({_W.format(10)})")
def _(spark, sf):
    return _r(P.rolling_z(P.daily_returns(prices(spark, sf)), "r", 10).select("symbol", "trade_date", "r_z"), "r_z", n=4)


_SERIES = "s AS (SELECT event_type AS series, CAST(ts AS DATE) AS trade_date, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL)"
_SZ = f"z AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM s WINDOW w AS (PARTITION BY series ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), l AS (SELECT series, max(trade_date) AS trade_date, arg_max(z, trade_date) AS z FROM z WHERE trade_date < {D} GROUP BY 1)"


def _series(spark, sf):
    return t(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("trade_date")).agg(F.count("*").cast("double").alias("value"))


@query("macro_z", f"WITH {_SERIES}, {_SZ} SELECT series, trade_date, round(z, 6) AS z, round((SELECT max(abs(z)) FROM l), 6) AS max_abs_z, series = (SELECT series FROM l ORDER BY abs(z) DESC, series DESC LIMIT 1) AS top_mover FROM l")
def _(spark, sf):
    return _r(P.macro_z(_series(spark, sf), DAY, 10), "z", "max_abs_z")


@query("flow_z", f"WITH {_SERIES}, {_SZ} SELECT series, trade_date, round(z, 6) AS z FROM l")
def _(spark, sf):
    return _r(P.series_z(_series(spark, sf), 10, DAY), "z")


@query("illiquidity", f"WITH {RETURNS} SELECT symbol, trade_date, round(abs(r) / nullif(volume * close, 0) * 1e3, 2) AS illiquidity FROM returns")
def _(spark, sf):
    p = prices(spark, sf).withColumn("turnover", F.col("volume") * F.col("close"))
    return P.illiquidity(p, "turnover").select("symbol", "trade_date", F.round(F.col("illiquidity") / 1e9, 2).alias("illiquidity"))


_NAV = """n AS (SELECT o_custkey % 40 AS fund, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS nav FROM orders GROUP BY ALL),
p AS (SELECT o_custkey % 40 AS fund, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS close FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def nav_and_price(spark, sf):
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    key = [(F.col("o_custkey") % 40).alias("fund"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("d")]
    nav = o.groupBy(*key).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("nav"))
    return nav, o.join(li, o.o_orderkey == li.l_orderkey).groupBy(*key).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("close"))


@query("nav_premium", f"WITH {_NAV} SELECT fund, d, round(close / nav - 1, 6) AS premium, round(nav / lag(nav) OVER (PARTITION BY fund ORDER BY d) - 1, 6) AS nav_return FROM n JOIN p USING (fund, d)")
def _(spark, sf):
    nav, price = nav_and_price(spark, sf)
    return _r(P.nav_premium(nav, price, "fund", "d").select("fund", "d", "premium", "nav_return"), "premium", "nav_return")


@query(
    "sector_returns",
    f"""WITH {PRICES}, {SECTORS}, i AS (SELECT sector, trade_date, sum(CAST(close AS DECIMAL(18,4))) AS close FROM prices JOIN sectors USING (symbol) GROUP BY ALL)
    SELECT sector, trade_date, round(ln(CAST(close AS DOUBLE) / CAST(lag(close) OVER (PARTITION BY sector ORDER BY trade_date) AS DOUBLE)), 6) AS sector_return FROM i""",
)
def _(spark, sf):
    i = prices(spark, sf).join(sectors(spark, sf), "symbol").groupBy("sector", "trade_date").agg(F.sum(F.col("close").cast("decimal(18,4)")).cast("double").alias("close"))
    return P.sector_returns(i).select("sector", "trade_date", F.round("sector_return", 6).alias("sector_return"))


@query(
    "fiscal_change",
    """WITH f AS (SELECT o_custkey AS symbol, year(o_orderdate) AS fiscal_year, make_date(year(o_orderdate) + 1, 4, 1) AS available_from, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders GROUP BY ALL)
    SELECT symbol, fiscal_year, round(revenue / nullif(lag(revenue) OVER (PARTITION BY symbol ORDER BY fiscal_year), 0) - 1, 6) AS revenue_chg FROM f WHERE available_from <= DATE '2000-06-01'""",
)
def _(spark, sf):
    from marketlens.functions.scalar import fiscal_available_from

    y = F.year("o_orderdate")
    f = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("symbol"), y.alias("fiscal_year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    f = f.withColumn("available_from", fiscal_available_from(F.col("fiscal_year"), 4))
    return _r(P.fiscal_change(f, ["revenue"], dt.date(2000, 6, 1)).select("symbol", "fiscal_year", "revenue_chg"), "revenue_chg")


@query(
    "flow_cumulative",
    """WITH f AS (SELECT user_id, CAST(ts AS DATE) AS d, CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS flow, count(*) AS turnover FROM events GROUP BY ALL)
    SELECT user_id, d, round(sum(flow) OVER w / nullif(avg(turnover) OVER w, 0), 6) AS cum_flow, count(*) OVER w AS n_rows, count(flow) OVER w AS n_flows FROM f WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    flow = F.sum(F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0))
    f = t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(flow.alias("flow"), F.count("*").alias("turnover"))
    return _r(P.flow_cumulative(f, 5, ["user_id"], "d").select("user_id", "d", "cum_flow", "n_rows", "n_flows"), "cum_flow")


@query(
    "overnight_moves",
    f"""WITH {PRICES}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev FROM prices WHERE trade_date < {D}),
    l AS (SELECT symbol, max(trade_date) AS trade_date, arg_max(close, trade_date) AS last_close FROM p GROUP BY 1)
    SELECT symbol, trade_date, last_close, p.prev AS prev_close, round(ln(last_close / p.prev), 9) AS move FROM l JOIN p USING (symbol, trade_date) WHERE trade_date = (SELECT max(trade_date) FROM l)""",
)
def _(spark, sf):
    return _r(P.overnight_moves(prices(spark, sf), DAY), "move", n=9)


@query("last_n_days", f"WITH {PRICES} SELECT symbol, trade_date, close FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 5")
def _(spark, sf):
    return P.last_n_days(prices(spark, sf), ["symbol"], "trade_date", 5).select("symbol", "trade_date", "close")


@query(
    "feature_panel",
    f"""WITH {RETURNS}, {SECTORS}, mac AS (SELECT CAST(ts AS DATE) AS trade_date, CAST(count(*) AS DOUBLE) AS macro FROM events WHERE event_type = 'error' GROUP BY 1),
    j AS (SELECT a.*, sector, CASE WHEN m.n >= {MIN_N} THEN market_mean END AS mr, macro FROM abnormal a LEFT JOIN sectors USING (symbol) LEFT JOIN market m USING (trade_date) LEFT JOIN mac USING (trade_date)),
    k AS (SELECT *, CASE WHEN count(ar) OVER (PARTITION BY trade_date, sector) >= 5 THEN ar - avg(ar) OVER (PARTITION BY trade_date, sector) END AS ind_ar, volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS vr FROM j)
    SELECT symbol, trade_date, round(r, 6) AS r, round(ar, 6) AS ar, round(ind_ar, 6) AS ind_ar, round(sum(ar) OVER s, 6) AS sum_n, round(stddev_samp(ar) OVER s, 6) AS sigma_n, round(lag(vr) OVER o, 6) AS volume_ratio,
        lag(close) OVER o AS close_l1, round((r - avg(r) OVER l) / nullif(stddev_samp(r) OVER l, 0), 4) AS r_z FROM k
    WINDOW o AS (PARTITION BY symbol ORDER BY trade_date), s AS ({_W.format(5)}), l AS ({_W.format(10)})""",
)
def feature_panel(spark, sf):
    macro = t(spark, sf, "events").where("event_type = 'error'").groupBy(F.to_date("ts").alias("trade_date")).agg(F.count("*").cast("double").alias("macro"))
    out = P.feature_panel(prices(spark, sf), sectors(spark, sf).select("symbol", "sector"), macro, MIN_N)
    return _r(_r(out.select("symbol", "trade_date", "r", "ar", "ind_ar", "sum_n", "sigma_n", "volume_ratio", "close_l1", "r_z"), "r", "ar", "ind_ar", "sum_n", "sigma_n", "volume_ratio"), "r_z", n=4)
