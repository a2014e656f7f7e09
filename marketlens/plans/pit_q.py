"""Point-in-time reads, as-of joins and bars over events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import bars as B
from marketlens.operators import pit
from marketlens.registry import query

from .bindings import AS_OF, BARS, DAY, HOLDINGS, PRICES, bars, holdings, ln_ratio, prices, t

D = f"DATE '{DAY}'"
TS = f"TIMESTAMP '{AS_OF}'"


@query("clamp_as_of", f"WITH {BARS} SELECT event_id, symbol, ts FROM bars WHERE available_at <= {TS}")
def _(spark, sf):
    return pit.clamp_as_of(bars(spark, sf), AS_OF).select("event_id", "symbol", "ts")


@query("bars_as_of", f"WITH {BARS} SELECT event_id, symbol, close FROM bars WHERE trade_date = {D} AND available_at <= {TS}")
def _(spark, sf):
    return pit.bars_as_of(bars(spark, sf), DAY, AS_OF).select("event_id", "symbol", "close")


@query("latest_by_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, sf):
    return pit.latest_by_key(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("as_of_by_key", f"SELECT user_id, event_type, event_id, value FROM events WHERE ts <= {TS} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, sf):
    return pit.as_of_by_key(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "ts", AS_OF).select("user_id", "event_type", "event_id", "value")


_PURCHASES = "p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS v_ts, value AS v_value FROM events WHERE event_type = 'view')"


def _sides(spark, sf):
    e = t(spark, sf, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", F.col("ts").alias("v_ts"), F.col("value").alias("v_value"))


@query("asof_join_backward", f"WITH {_PURCHASES} SELECT event_id, p.user_id, ts, v_ts, v_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.v_ts")
def _(spark, sf):
    left, right = _sides(spark, sf)
    return pit.asof_join_backward(left, right, ["user_id"], "ts", "v_ts", ["v_ts", "v_value"])


@query("asof_join_forward", f"WITH {_PURCHASES} SELECT event_id, user_id, ts, (SELECT min(v_ts) FROM v WHERE v.user_id = p.user_id AND v.v_ts >= p.ts) AS effective FROM p")
def _(spark, sf):
    left, right = _sides(spark, sf)
    return pit.asof_join_forward(left, right.select("user_id", "v_ts"), ["user_id"], "ts", "v_ts", "effective")


@query(
    "asof_join_cross_calendar",
    """WITH l AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT CAST(l_shipdate AS DATE) AS s, count(*) AS n_shipped FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey, d, s, n_shipped FROM l ASOF LEFT JOIN r ON l.d > r.s""",
)
def _(spark, sf):
    left = t(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    right = t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.to_date("l_shipdate").alias("s")).agg(F.count("*").alias("n_shipped"))
    return pit.asof_join_cross_calendar(left, right, "d", "s", ["s", "n_shipped"]).select("o_orderkey", "d", "s", "n_shipped")


SNAP = dt.date(1998, 7, 1)


@query("snapshot_as_of", f"WITH {HOLDINGS} SELECT fund, constituent, as_of_date, round(weight, 9) AS weight FROM holdings WHERE as_of_date <= DATE '{SNAP}' QUALIFY as_of_date = max(as_of_date) OVER (PARTITION BY fund)")
def _(spark, sf):
    return pit.snapshot_as_of(holdings(spark, sf), ["fund"], "as_of_date", SNAP).select("fund", "constituent", "as_of_date", F.round("weight", 9).alias("weight"))


@query(
    "snapshot_as_of_or_next",
    f"""WITH {HOLDINGS}, h AS (SELECT * FROM holdings WHERE fund % 2 = 0 OR as_of_date > DATE '{SNAP}'),
    c AS (SELECT fund, max(as_of_date) FILTER (as_of_date <= DATE '{SNAP}') AS past, min(as_of_date) FILTER (as_of_date > DATE '{SNAP}') AS nxt FROM h GROUP BY 1)
    SELECT h.fund, constituent, h.as_of_date, past IS NULL AS is_future FROM h JOIN c ON h.fund = c.fund AND h.as_of_date = coalesce(past, nxt)""",
)
def _(spark, sf):
    h = holdings(spark, sf).where((F.col("fund") % 2 == 0) | (F.col("as_of_date") > F.lit(SNAP)))
    return pit.snapshot_as_of_or_next(h, ["fund"], "as_of_date", SNAP).select("fund", "constituent", "as_of_date", "is_future")


@query(
    "snapshot_skip_sparse",
    f"""WITH {HOLDINGS}, h AS (SELECT fund, constituent, as_of_date, CASE WHEN (fund + constituent + year(as_of_date)) % 3 > 0 AND NOT (year(as_of_date) = 1998 AND fund % 2 = 1) THEN constituent END AS v FROM holdings),
    s AS (SELECT fund, as_of_date FROM h WHERE as_of_date <= DATE '{SNAP}' GROUP BY ALL HAVING avg(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) >= 0.5),
    m AS (SELECT fund, max(as_of_date) AS as_of_date FROM s GROUP BY 1) SELECT h.fund, h.constituent, h.as_of_date, v FROM h JOIN m USING (fund, as_of_date)""",
)
def _(spark, sf):
    y = F.year("as_of_date")
    v = F.when(((F.col("fund") + F.col("constituent") + y) % 3 > 0) & ~((y == 1998) & (F.col("fund") % 2 == 1)), F.col("constituent"))
    return pit.snapshot_skip_sparse(holdings(spark, sf).withColumn("v", v), ["fund"], "as_of_date", "v", SNAP).select("fund", "constituent", "as_of_date", "v")


@query(
    "prev_close_bounded",
    f"""WITH {BARS}, b AS (SELECT * FROM bars WHERE trade_date < {D}), near AS (SELECT symbol, max(trade_date) AS prev_date FROM b WHERE trade_date >= {D} - 400 GROUP BY 1)
    SELECT symbol, prev_date, arg_max(close, ts) AS prev_close FROM near JOIN b USING (symbol) WHERE trade_date = prev_date GROUP BY 1, 2""",
)
def _(spark, sf):
    b = bars(spark, sf)
    return pit.prev_close_bounded(b, b.select("symbol"), DAY, (2, 10, 400))


@query("prev_close_baseline", f"WITH {PRICES} SELECT symbol, max(trade_date) AS prev_date, arg_max(close, trade_date) AS prev_close FROM prices WHERE trade_date < {D} GROUP BY 1")
def _(spark, sf):
    return pit.prev_close_baseline(prices(spark, sf), DAY)


@query("timestamp_sidecar", "SELECT user_id, min(ts) AS ts FROM events WHERE strftime(ts, '%H:%M:%S') <> '00:00:00' GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events")
    return pit.timestamp_sidecar(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "ts")


# Bars

_SLOT = "to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP"
_OHLCV = "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume"


@query("rollup_bars", f"WITH {BARS}, b AS (SELECT *, {_SLOT} AS slot FROM bars) SELECT symbol, slot AS ts, {_OHLCV}, slot + INTERVAL 60 MINUTE AS available_at FROM b WHERE slot + INTERVAL 60 MINUTE <= {TS} GROUP BY symbol, slot")
def _(spark, sf):
    return B.rollup_bars(bars(spark, sf), 60, AS_OF)


_S0, _S1 = dt.datetime(2024, 1, 20, 9, 0), dt.datetime(2024, 1, 20, 15, 30)


@query(
    "rollup_session",
    f"""WITH {BARS}, b AS (SELECT *, CAST(floor((epoch(ts) - epoch(TIMESTAMP '{_S0}')) / 7200) AS BIGINT) AS slot FROM bars WHERE ts >= TIMESTAMP '{_S0}' AND ts < TIMESTAMP '{_S1}'),
    g AS (SELECT symbol, slot, {_OHLCV} FROM b GROUP BY symbol, slot), u AS (SELECT slot, count(*) AS units FROM g GROUP BY 1)
    SELECT symbol, open, high, low, close, volume, units >= (SELECT max(units) FROM u) AS complete, TIMESTAMP '{_S0}' + slot * INTERVAL 2 HOUR AS ts,
        least(TIMESTAMP '{_S0}' + (slot + 1) * INTERVAL 2 HOUR, TIMESTAMP '{_S1}') AS available_at FROM g JOIN u USING (slot)""",
)
def _(spark, sf):
    return B.rollup_session(bars(spark, sf), _S0, _S1, 120)


@query(
    "rollup_daily",
    f"""WITH {PRICES} SELECT symbol, trade_date, open, high, low, close, CASE WHEN trade_date >= DATE '2024-01-10' THEN volume END AS volume,
    round(close / nullif(lag(close) OVER w, 0) - 1, 9) AS simple_return, round(ln(CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN close / lag(close) OVER w END), 9) AS log_return FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""",
)
def _(spark, sf):
    return B.rollup_daily(bars(spark, sf), dt.date(2024, 1, 10)).withColumn("simple_return", F.round("simple_return", 9)).withColumn("log_return", F.round("log_return", 9))


_CLOCK = f"trade_date = {D} AND strftime(ts, '%H:%M:%S') >= '09:00:00' AND strftime(ts, '%H:%M:%S') < '15:30:00'"


@query("slice_clock", f"WITH {BARS} SELECT event_id, symbol, ts, close FROM bars WHERE {_CLOCK}")
def _(spark, sf):
    return B.slice_clock(bars(spark, sf), DAY, "09:00:00", "15:30:00").select("event_id", "symbol", "ts", "close")


@query("clock_return", f"WITH {BARS} SELECT symbol, round({ln_ratio('arg_max(close, ts)', 'arg_min(open, ts)')}, 9) AS clock_return, CAST(sum(volume) AS BIGINT) AS volume FROM bars WHERE {_CLOCK} GROUP BY 1")
def _(spark, sf):
    return B.clock_return(bars(spark, sf), DAY, "09:00:00", "15:30:00").withColumn("clock_return", F.round("clock_return", 9))


_W0, _W1 = dt.datetime(2024, 1, 20, 9, 7), dt.datetime(2024, 1, 20, 14, 23)


@query("slice_requested_window", f"WITH {BARS}, b AS (SELECT *, greatest({_SLOT}, TIMESTAMP '{_W0}') AS slot FROM bars WHERE ts >= TIMESTAMP '{_W0}' AND ts < TIMESTAMP '{_W1}') SELECT symbol, slot AS ts, {_OHLCV} FROM b GROUP BY symbol, slot")
def _(spark, sf):
    return B.slice_requested_window(bars(spark, sf), _W0, _W1, 60)


@query(
    "gap_return",
    f"""WITH {PRICES} SELECT symbol, trade_date, open AS day_open, close AS day_close, lag(close) OVER w AS prev_close, round({ln_ratio('open', 'lag(close) OVER w')}, 9) AS gap FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""",
)
def _(spark, sf):
    return B.gap_return(bars(spark, sf)).withColumn("gap", F.round("gap", 9))


@query(
    "window_return",
    f"""WITH {BARS}, w AS (SELECT 0 AS window_id, TIMESTAMP '2024-01-20 00:00:00' AS w_start, TIMESTAMP '2024-01-20 08:00:00' AS w_end UNION ALL SELECT 1, TIMESTAMP '2024-01-20 08:00:00', TIMESTAMP '2024-01-20 23:00:00'),
    s AS (SELECT DISTINCT symbol FROM bars WHERE trade_date = {D})
    SELECT s.symbol, window_id, round({ln_ratio('arg_max(close, ts)', 'arg_min(open, ts)')}, 9) AS window_return, count(ts) AS n_bars FROM s CROSS JOIN w LEFT JOIN bars b ON b.symbol = s.symbol AND ts >= w_start AND ts < w_end GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = [(0, dt.datetime(2024, 1, 20, 0), dt.datetime(2024, 1, 20, 8)), (1, dt.datetime(2024, 1, 20, 8), dt.datetime(2024, 1, 20, 23))]
    windows = spark.createDataFrame(rows, "window_id int, w_start timestamp, w_end timestamp")
    return B.window_return(bars(spark, sf), windows).withColumn("window_return", F.round("window_return", 9))


@query(
    "bars_per_day_histogram",
    f"""WITH {BARS}, h AS (SELECT n_bars, count(*) AS symbol_days FROM (SELECT symbol, trade_date, count(*) AS n_bars FROM bars GROUP BY ALL) GROUP BY 1)
    SELECT n_bars, symbol_days, n_bars = (SELECT n_bars FROM h ORDER BY symbol_days DESC, n_bars DESC LIMIT 1) AS is_mode FROM h""",
)
def _(spark, sf):
    return B.bars_per_day_histogram(bars(spark, sf))


@query(
    "window_coverage",
    f"""WITH {BARS}, u AS (SELECT c_custkey AS symbol, c_acctbal + 1000 AS weight FROM customer),
    n AS (SELECT u.symbol, weight, count(DISTINCT date_trunc('minute', ts)) AS n FROM u LEFT JOIN bars b ON b.symbol = u.symbol AND ts >= TIMESTAMP '2024-01-20 12:00:00' AND ts < TIMESTAMP '2024-01-20 12:02:00' GROUP BY 1, 2)
    SELECT count(*) * 2 AS expected, CAST(sum(n) AS BIGINT) AS observed, count(*) FILTER (n >= 2) AS complete_units, min(n / 2.0) AS min_coverage, round(coalesce(sum(weight) FILTER (n >= 2), 0) / sum(weight), 9) AS weight_coverage FROM n""",
)
def _(spark, sf):
    u = t(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), (F.col("c_acctbal") + 1000).alias("weight"))
    return B.window_coverage(bars(spark, sf), u, dt.datetime(2024, 1, 20, 12, 0), dt.datetime(2024, 1, 20, 12, 2)).withColumn("weight_coverage", F.round("weight_coverage", 9))


@query(
    "path_returns",
    f"""WITH {BARS}, own AS (SELECT l_partkey % 5 AS unit, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, min(l_extendedprice) AS open, max(l_extendedprice) AS close FROM lineitem GROUP BY ALL),
    k AS (SELECT ts FROM own WHERE unit IN (0, 1, 2) GROUP BY 1 HAVING count(DISTINCT unit) = 3)
    SELECT unit, ts, round(ln(close / coalesce(lag(close) OVER (PARTITION BY unit ORDER BY ts), open)), 9) AS path_return FROM own WHERE unit IN (0, 1, 2) AND ts IN (SELECT ts FROM k)""",
)
def _(spark, sf):
    own = t(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 5).alias("unit"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(F.min("l_extendedprice").alias("open"), F.max("l_extendedprice").alias("close"))
    return B.path_returns(own, [0, 1, 2], key="unit").select("unit", "ts", F.round("path_return", 9).alias("path_return"))


@query(
    "slot_differences",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, hour(ts) // 5 AS slot, sum(count(*)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY hour(ts) // 5) AS cum FROM events GROUP BY 1, 2, 3)
    SELECT user_id, d, CAST(slot AS INT) AS slot, CAST(cum - coalesce(lag(cum) OVER (PARTITION BY user_id, d ORDER BY slot), 0) AS BIGINT) AS slot_value FROM s""",
)
def _(spark, sf):
    from pyspark.sql import Window

    n = t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d"), F.floor(F.hour("ts") / 5).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    cum = n.withColumn("cum", F.sum("n").over(Window.partitionBy("user_id", "d").orderBy("slot")))
    return B.slot_differences(cum, ["user_id", "d"], "slot", "cum").select("user_id", "d", "slot", "slot_value")


@query("dedup_bars", "SELECT user_id, date_trunc('hour', ts) AS h, max(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("h", F.date_trunc("hour", "ts"))
    return B.dedup_bars(e, ["user_id", "h"], "event_id").select("user_id", "h", "event_id")


@query(
    "reconcile_sources",
    f"""WITH {PRICES}, daily AS (SELECT symbol, trade_date, CASE WHEN symbol % 17 = 0 THEN close + 1 ELSE close END AS close FROM prices)
    SELECT trade_date, count(*) AS joined, count(*) FILTER (abs(d.close - p.close) > 1e-9) AS mismatched, count(*) = 0 OR count(*) FILTER (abs(d.close - p.close) > 1e-9) > 0 AS failed FROM daily d JOIN prices p USING (symbol, trade_date) GROUP BY 1""",
)
def _(spark, sf):
    daily = prices(spark, sf).withColumn("close", F.when(F.col("symbol") % 17 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return B.reconcile_sources(daily, bars(spark, sf))
