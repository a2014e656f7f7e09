"""Reporting over runs, windows, jobs and results, which orders, lines and events stand for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import reporting as O
from marketlens.registry import query

from .bindings import DAY, PRICES, RETURNS, SECTORS, prices, returns, sectors, t

D = f"DATE '{DAY}'"
NOW = dt.datetime(2024, 1, 20, 12)


@query("latest_per_day_trend", "WITH l AS (SELECT CAST(ts AS DATE) AS d, event_id, ts FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC) = 1) SELECT d, event_id FROM l ORDER BY d DESC LIMIT 10")
def _(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("d"), (F.col("event_type") != "error").alias("ok"))
    return O.latest_per_day_trend(e, 10).select("d", "event_id")


@query(
    "ledger_latest",
    "WITH a AS (SELECT user_id, ts, event_id, event_type AS lane FROM events WHERE event_type IN ('view', 'click')), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_id AS trigger_id, lane, o_orderstatus AS outcome FROM l LEFT JOIN orders ON o_orderkey = event_id",
)
def _(spark, sf):
    e = t(spark, sf, "events").withColumnRenamed("event_id", "trigger_id")
    out = t(spark, sf, "orders").select(F.col("o_orderkey").alias("trigger_id"), F.col("o_orderstatus").alias("outcome"))
    return O.ledger_latest({x: e.where(F.col("event_type") == x) for x in ("view", "click")}, out, "user_id").select("user_id", "trigger_id", "lane", "outcome")


@query("daily_outputs", "SELECT 'events' AS output, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'orders', CAST(o_orderdate + INTERVAL 9 HOUR AS DATE), count(*) FROM orders GROUP BY 2")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    o = t(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return O.daily_outputs({"events": (e, "ts"), "orders": (o, "ts")}, "Asia/Seoul")


_WIN = "win AS (SELECT user_id % 10 AS session_id, ts AS window_start, ts + INTERVAL 1 MINUTE AS window_end, CASE event_type WHEN 'view' THEN 'DUE' WHEN 'click' THEN 'CLAIMED' WHEN 'signup' THEN 'VALID' WHEN 'error' THEN 'INVALID' ELSE 'MISSING' END AS status FROM events)"
_LATE = f"status IN ('DUE', 'CLAIMED') AND window_end < TIMESTAMP '{NOW}'"


def windows(spark, sf):
    e = F.col("event_type")
    s = F.when(e == "view", "DUE").when(e == "click", "CLAIMED").when(e == "signup", "VALID").when(e == "error", "INVALID").otherwise("MISSING")
    ts = F.col("ts").cast("timestamp")
    return t(spark, sf, "events").select((F.col("user_id") % 10).alias("session_id"), ts.alias("window_start"), (ts + F.expr("INTERVAL 1 MINUTE")).alias("window_end"), s.alias("status"))


@query("window_status_counts", f"WITH {_WIN} SELECT session_id, status, count(*) AS n, count(*) FILTER ({_LATE}) AS overdue FROM win GROUP BY 1, 2")
def _(spark, sf):
    return O.window_status_counts(windows(spark, sf), NOW)


@query("gap_list", f"WITH {_WIN} SELECT session_id, window_start, CASE WHEN status IN ('MISSING', 'INVALID') THEN status ELSE 'OVERDUE' END AS reason FROM win WHERE status IN ('MISSING', 'INVALID') OR ({_LATE})")
def _(spark, sf):
    return O.gap_list(windows(spark, sf), NOW)


@query(
    "overview_latest",
    "WITH r AS (SELECT o_custkey % 50 AS pipeline, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1) SELECT pipeline, run_id, l_linenumber, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS stage_order FROM r LEFT JOIN lineitem ON l_orderkey = run_id",
)
def _(spark, sf):
    runs = t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("pipeline"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    tasks = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", F.col("l_returnflag").alias("stage"))
    return O.overview_latest(runs, tasks, ["N", "A", "R"]).select("pipeline", "run_id", "l_linenumber", "stage_order")


@query("missing_slots", "SELECT o_orderkey AS slot FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    issues = t(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"), (F.col("o_orderstatus") == "O").alias("is_open"))
    return O.missing_slots(issues, t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slot")), "slot").select("slot")


@query(
    "job_counts",
    f"""WITH j AS (SELECT user_id % 10 AS session_id, CASE event_type WHEN 'view' THEN 'WAITING' WHEN 'click' THEN 'CLAIMED' WHEN 'signup' THEN 'SUCCEEDED' ELSE 'DEAD' END AS status, ts < TIMESTAMP '{NOW}' AS late FROM events)
    SELECT session_id, count(*) FILTER (status = 'WAITING') AS waiting, count(*) FILTER (status = 'CLAIMED' AND NOT late) AS claimed, count(*) FILTER (status = 'CLAIMED' AND late) AS expired, count(*) FILTER (status = 'SUCCEEDED') AS succeeded, count(*) FILTER (status = 'DEAD') AS dead FROM j GROUP BY 1""",
)
def _(spark, sf):
    e = F.col("event_type")
    s = F.when(e == "view", "WAITING").when(e == "click", "CLAIMED").when(e == "signup", "SUCCEEDED").otherwise("DEAD")
    return O.job_counts(t(spark, sf, "events").select((F.col("user_id") % 10).alias("session_id"), s.alias("status"), F.col("ts").cast("timestamp").alias("lease_until")), NOW)


@query("coverage_counts", "SELECT count(*) AS documents, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS with_assertion, count(*) FILTER (o_orderkey IN (SELECT event_id FROM events)) AS used FROM orders")
def _(spark, sf):
    k = lambda n, c: t(spark, sf, n).select(F.col(c).alias("k"))
    return O.coverage_counts(k("orders", "o_orderkey"), k("lineitem", "l_orderkey"), k("events", "event_id"), "k")


@query("traffic_summary", f"SELECT count(*) AS requests, coalesce(CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT), 0) AS errors FROM events WHERE ts >= TIMESTAMP '{NOW}'")
def _(spark, sf):
    return O.traffic_summary(t(spark, sf, "events"), NOW, error=F.col("event_type") == "error")


@query("status_count", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1")
def _(spark, sf):
    return O.status_count(t(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), ["O", "F"])


@query("feed_summary", f"SELECT count(*) FILTER (ts >= TIMESTAMP '{NOW}') AS received, max(ts) AS last_received FROM events")
def _(spark, sf):
    return O.feed_summary(t(spark, sf, "events"), NOW)


@query("result_latest", "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, sf):
    return O.result_latest(t(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("serving_head", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, sf):
    p = t(spark, sf, "orders").withColumn("published", F.col("o_orderstatus") == "F")
    scopes = t(spark, sf, "customer").where("c_acctbal < 0").select(F.lit("FUND").alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    scopes = scopes.union(t(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select(F.lit("MARKET"), "o_orderpriority").distinct())
    return O.serving_head(p, scopes, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "evidence_top_per_type",
    "WITH d AS (SELECT DISTINCT l_suppkey, l_returnflag, l_partkey FROM lineitem) SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS total, CAST(row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_partkey) AS INT) AS nth FROM d QUALIFY nth <= 3",
)
def _(spark, sf):
    return O.evidence_top_per_type(t(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_partkey"), 3, ["l_suppkey", "l_returnflag"], ["l_partkey"])


@query("top_contributors", "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS INT) AS rank FROM customer QUALIFY rank <= 3")
def _(spark, sf):
    return O.top_contributors(t(spark, sf, "customer"), "c_acctbal", 3, "c_custkey", ["c_nationkey"]).select("c_nationkey", "c_custkey", "rank")


@query("capped_result", "SELECT o_orderkey, o_custkey, true AS truncated FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, sf):
    return O.capped_result(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), 100, 1_000_000, ["o_orderkey"])


@query("page_by_time", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 200")
def _(spark, sf):
    return O.page_by_time(t(spark, sf, "events").select("event_id", "ts"), "ts", "event_id", 50, 200)


@query("deterministic_order", "SELECT event_id, 1 AS n FROM events")
def _(spark, sf):
    return O.deterministic_order(t(spark, sf, "events"), ["event_id"], 7).groupBy("event_id").agg(F.countDistinct("draw").cast("int").alias("n"))


@query(
    "contract_book",
    """WITH c AS (SELECT o_custkey % 60 AS owner, o_orderkey % 300 AS k, o_custkey % 7 AS party, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 400 AS e, CAST(o_orderdate AS DATE) - 30 + CAST(o_orderkey % 20 AS INT) AS reported, o_orderkey AS id FROM orders),
    l AS (SELECT * FROM c WHERE reported <= DATE '1998-06-01' QUALIFY row_number() OVER (PARTITION BY owner, k ORDER BY reported DESC, id DESC) = 1), x AS (SELECT *, s <= DATE '1998-06-01' AND e > DATE '1998-06-01' AS live FROM l),
    p AS (SELECT owner, party, CAST(sum(amount) FILTER (live) AS DOUBLE) AS p FROM x GROUP BY 1, 2), h AS (SELECT owner, sum((p / t) ** 2) AS hhi FROM (SELECT *, sum(p) OVER (PARTITION BY owner) AS t FROM p) GROUP BY 1)
    SELECT owner, count(*) FILTER (live) AS n_live, CAST(sum(amount) FILTER (live) AS DOUBLE) AS live, CAST(sum(amount) FILTER (s > DATE '1998-06-01') AS DOUBLE) AS backlog, count(*) FILTER (live AND e <= DATE '1998-06-01' + 90) AS expiring, round(any_value(hhi), 6) AS hhi FROM x LEFT JOIN h USING (owner) GROUP BY 1""",
)
def _(spark, sf):
    d = F.to_date("o_orderdate")
    c = t(spark, sf, "orders").select((F.col("o_custkey") % 60).alias("owner"), (F.col("o_orderkey") % 300).alias("k"), (F.col("o_custkey") % 7).alias("party"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), d.alias("s"), F.date_add(d, 400).alias("e"), F.date_add(d, -30 + (F.col("o_orderkey") % 20).cast("int")).alias("reported"), F.col("o_orderkey").alias("id"))
    c = c.withColumn("reported_id", F.struct("reported", "id"))
    day = dt.date(1998, 6, 1)
    last = O.result_latest(c.where(F.col("reported") <= F.lit(day)), ["owner", "k"], ["reported", "id"])
    return O.contract_book(last.drop("reported_id"), day, "k", "party", "amount", "s", "e", "reported").select("owner", "n_live", F.col("live").cast("double").alias("live"), F.col("backlog").cast("double").alias("backlog"), "expiring", F.round("hhi", 6).alias("hhi"))


@query(
    "statement_pick",
    """WITH l AS (SELECT o_custkey AS corp_code, year(o_orderdate) AS bsns_year, CASE WHEN o_orderkey % 2 = 0 THEN 'CFS' ELSE 'OFS' END AS fs_div, o_orderpriority AS account_id, CAST(o_orderdate AS DATE) AS available_at, o_orderkey FROM orders)
    SELECT corp_code, bsns_year, fs_div, account_id, available_at FROM l WHERE available_at <= DATE '1999-01-01' AND account_id IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY bsns_year DESC, CASE fs_div WHEN 'CFS' THEN 0 ELSE 1 END, CASE account_id WHEN '1-URGENT' THEN 0 ELSE 1 END, available_at DESC) = 1""",
)
def _(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("corp_code"), F.year("o_orderdate").alias("bsns_year"), F.when(F.col("o_orderkey") % 2 == 0, "CFS").otherwise("OFS").alias("fs_div"), F.col("o_orderpriority").alias("account_id"), F.to_date("o_orderdate").alias("available_at"))
    return O.statement_pick(o, ["1-URGENT", "2-HIGH"], dt.date(1999, 1, 1))


@query(
    "consensus_revision",
    f"""WITH {PRICES}, p AS (SELECT * FROM prices WHERE trade_date <= {D}), n AS (SELECT symbol, max(trade_date) AS latest_at, arg_max(close, trade_date) AS latest FROM p GROUP BY 1), o AS (SELECT symbol, arg_max(close, trade_date) AS prior FROM p JOIN n USING (symbol) WHERE trade_date <= latest_at - 5 GROUP BY 1),
    r AS (SELECT *, CASE WHEN latest > 0 AND prior > 0 THEN ln(latest / prior) WHEN prior <> 0 THEN (latest - prior) / abs(prior) END AS rev FROM n JOIN o USING (symbol)) SELECT symbol, latest_at, round(rev, 6) AS revision, CASE WHEN rev IS NOT NULL THEN round(percent_rank() OVER (PARTITION BY rev IS NULL ORDER BY round(rev, 12)), 6) END AS pct FROM r""",
)
def _(spark, sf):
    s = prices(spark, sf).select("symbol", F.col("trade_date").alias("as_of_date"), F.col("close").alias("value"))
    return O.consensus_revision(s, DAY, 5).select("symbol", "latest_at", F.round("revision", 6).alias("revision"), F.round("pct", 6).alias("pct"))


_ITEMS = "it AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date, event_type AS item_code, max(value) AS value FROM events GROUP BY ALL)"


def _items(spark, sf):
    return t(spark, sf, "events").groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"), F.col("event_type").alias("item_code")).agg(F.max("value").alias("value"))


@query(
    "item_probe",
    f"""WITH {_ITEMS}, z AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM it WHERE item_code = 'view' AND trade_date <= {D} WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    l AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1) SELECT symbol, trade_date, value, round(z, 4) AS z, round(cume_dist() OVER (ORDER BY value), 6) AS pct FROM l""",
)
def _(spark, sf):
    return O.item_probe(_items(spark, sf), "view", DAY, 5).select("symbol", "trade_date", "value", F.round("z", 4).alias("z"), F.round("pct", 6).alias("pct"))


_EVS = "ev AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS trade_date FROM events WHERE event_type = 'error')"


def _errs(spark, sf):
    return t(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date")).distinct()


@query(
    "base_rate",
    f"""WITH {RETURNS}, {_EVS}, td AS (SELECT symbol, r AS today FROM returns WHERE trade_date = {D} AND r IS NOT NULL), p AS (SELECT r.symbol, r, today, ev.symbol IS NOT NULL AS e FROM returns r JOIN td USING (symbol) LEFT JOIN ev ON ev.symbol = r.symbol AND ev.trade_date = r.trade_date WHERE r.trade_date < {D} AND r IS NOT NULL)
    SELECT symbol, count(*) AS n, count(*) FILTER (e) AS n_event, CASE WHEN count(*) >= 10 THEN round(avg(CASE WHEN abs(r) >= abs(today) THEN 1 ELSE 0 END), 6) END AS exceed, CASE WHEN count(*) FILTER (e) >= 4 THEN round(avg(CASE WHEN abs(r) >= abs(today) THEN 1 ELSE 0 END) FILTER (e), 6) END AS exceed_event FROM p GROUP BY 1""",
)
def _(spark, sf):
    b = O.base_rate(returns(spark, sf), _errs(spark, sf), DAY, 4)
    return b.select("symbol", "n", "n_event", F.when(F.col("n") >= 10, F.round("exceed", 6)).alias("exceed"), F.round("exceed_event", 6).alias("exceed_event"))


@query(
    "peer_rank",
    f"""WITH {RETURNS}, {SECTORS}, o AS (SELECT symbol, sector, r FROM returns JOIN sectors USING (symbol) WHERE trade_date = {D} AND r IS NOT NULL), s AS (SELECT sector, median(r) AS m, count(*) AS n, count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS dn FROM o GROUP BY 1)
    SELECT symbol, sector, CASE WHEN n >= 20 THEN CAST(rank() OVER (PARTITION BY sector ORDER BY r DESC) AS INT) END AS rank, CASE WHEN n >= 20 THEN round(m, 6) END AS median, CASE WHEN n >= 20 THEN round(r - m, 6) END AS spread,
    CASE WHEN n >= 20 THEN round((CASE WHEN r > 0 THEN up - 1 WHEN r < 0 THEN dn - 1 ELSE 0 END) / (n - 1), 6) END AS agreement, CASE WHEN n >= 20 THEN 'MEASURED' ELSE 'TOO_FEW_PEERS' END AS verdict FROM o JOIN s USING (sector)""",
)
def _(spark, sf):
    p = O.peer_rank(returns(spark, sf).join(sectors(spark, sf), "symbol"), DAY, 20)
    return p.withColumns({c: F.round(c, 6) for c in ("median", "spread", "agreement")})


@query(
    "event_distribution",
    f"""WITH {RETURNS}, e AS (SELECT DISTINCT event_type, user_id AS symbol, CAST(ts AS DATE) AS trade_date FROM events WHERE ts < TIMESTAMP '{DAY}'), td AS (SELECT event_type, avg(value) / 100 - 0.5 AS today FROM events WHERE CAST(ts AS DATE) = {D} GROUP BY 1)
    SELECT event_type, count(*) AS n, round(avg(r), 6) AS mean, round(avg(CASE WHEN r <= today THEN 1 ELSE 0 END), 6) AS ecdf FROM e JOIN returns USING (symbol, trade_date) JOIN td USING (event_type) WHERE r IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    e = t(spark, sf, "events")
    past = e.where(F.to_date("ts") < F.lit(DAY)).select("event_type", F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date")).distinct()
    today = e.where(F.to_date("ts") == F.lit(DAY)).groupBy("event_type").agg((F.avg("value") / 100 - 0.5).alias("today"))
    return O.event_distribution(past, returns(spark, sf), today, 1).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("ecdf", 6).alias("ecdf"))


@query(
    "actor_flow",
    f"""WITH f AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date, event_type AS actor, count(*) AS flow FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL), u AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date, count(*) AS turnover FROM events GROUP BY ALL),
    c AS (SELECT symbol, actor, trade_date, sum(flow) OVER w / nullif(avg(turnover) OVER w, 0) AS cum FROM f JOIN u USING (symbol, trade_date) WHERE trade_date <= {D} WINDOW w AS (PARTITION BY symbol, actor ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    z AS (SELECT *, (cum - avg(cum) OVER w) / nullif(stddev_samp(cum) OVER w, 0) AS z FROM c WINDOW w AS (PARTITION BY symbol, actor ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), l AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY symbol, actor ORDER BY trade_date DESC) = 1),
    g AS (SELECT DISTINCT symbol, unnest(['view', 'click', 'foreign']) AS actor FROM f) SELECT g.symbol, g.actor, round(cum, 6) AS cum, CASE WHEN abs(z) < 1e6 THEN round(z, 3) END AS z FROM g LEFT JOIN l USING (symbol, actor)""",
)
def _(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"), F.col("event_type").alias("actor"))
    f = e.where("actor IN ('view', 'click')").groupBy("symbol", "trade_date", "actor").agg(F.count("*").alias("flow"))
    u = e.groupBy("symbol", "trade_date").agg(F.count("*").alias("turnover"))
    out = O.actor_flow(f, u, ["view", "click", "foreign"], DAY, 3, 5)
    return out.select("symbol", "actor", F.round("cum", 6).alias("cum"), F.when(F.abs("z") < 1e6, F.round("z", 3)).alias("z"))
