"""Gates and merges over tables with faults that follow from the rows' own numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import quality as Q
from marketlens.registry import query

from .bindings import PRICES, bars, prices, t

MAX = dt.date(2000, 1, 1)
M = f"DATE '{MAX}'"


def _gate(df, rules, *cols):
    out = Q.judged(df, rules)
    return out.select(*cols, F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), "passed")


def _sql(base: str, cols: str, blocking: dict[str, str], warnings: dict[str, str] | None = None) -> str:
    """The gate as SQL: names joined where their condition holds."""
    r = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in blocking.items())
    w = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in (warnings or {}).items())
    return f"WITH x AS ({base}), j AS (SELECT {cols}, concat_ws(',', {r}) AS reasons, {f"concat_ws(',', {w})" if w else "''"} AS warnings FROM x) SELECT *, reasons = '' AS passed FROM j"


@query(
    "gate_ohlcv",
    _sql(
        "SELECT event_id, value - CASE WHEN event_id % 40 = 0 THEN 100 ELSE 0 END AS open, value * (CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 1.1 END) AS high, value * (CASE WHEN event_id % 9 = 0 THEN 1.2 ELSE 0.9 END) AS low, value AS close, user_id - 5 AS volume FROM events",
        "event_id",
        {"non_positive_price": "least(open, high, low, close) <= 0", "negative_volume": "volume < 0", "high_below_low": "high < low", "high_below_body": "high < greatest(open, close)", "low_above_body": "low > least(open, close)"},
    ),
)
def _(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    x = t(spark, sf, "events").select("event_id", (v - F.when(k % 40 == 0, 100).otherwise(0)).alias("open"), (v * F.when(k % 7 == 0, 0.5).otherwise(1.1)).alias("high"), (v * F.when(k % 9 == 0, 1.2).otherwise(0.9)).alias("low"), v.alias("close"), (F.col("user_id") - 5).alias("volume"))
    return _gate(x, Q.ohlcv_rules(), "event_id")


@query(
    "gate_holdings",
    _sql(
        "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'JP' WHEN 1 THEN ' ' ELSE 'KR' END AS market, nullif(o_custkey % 9, 0) AS etf_id, nullif(o_custkey % 8, 0) AS tick, CAST(o_orderdate AS DATE) AS d, o_totalprice / 4000 AS w, o_custkey - 100 AS shares, o_totalprice - 5000 AS v FROM orders",
        "o_orderkey",
        {"missing_market": "trim(market) = ''", "unsupported_market": "market = 'JP'", "missing_fund": "etf_id IS NULL", "missing_constituent": "tick IS NULL", "date_out_of_range": f"d > {M}"},
        {"weight_out_of_range": "NOT (w > 0 AND w <= 100)", "negative_shares": "shares < 0", "negative_value": "v < 0"},
    ),
)
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = t(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "JP").when(k % 5 == 1, " ").otherwise("KR").alias("market"), F.nullif(c % 9, F.lit(0)).alias("etf_id"), F.nullif(c % 8, F.lit(0)).alias("constituent_ticker"), F.to_date("o_orderdate").alias("as_of_date"),
        (F.col("o_totalprice") / 4000).alias("weight_pct"), (c - 100).alias("shares"), (F.col("o_totalprice") - 5000).alias("market_value"),
    )
    return _gate(x, Q.holdings_rules(MAX), "o_orderkey")


@query(
    "gate_nav",
    _sql(
        "SELECT o_orderkey, nullif(o_custkey % 9, 0) AS etf_id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1e17 ELSE o_totalprice END AS nav, CAST(o_orderdate AS DATE) AS d FROM orders",
        "o_orderkey",
        {"missing_fund": "etf_id IS NULL", "missing_nav": "nav IS NULL", "non_positive_nav": "nav <= 0", "nav_too_large": "nav >= 1e16", "date_out_of_range": f"d > {M}"},
    ),
)
def _(spark, sf):
    k = F.col("o_orderkey") % 6
    x = t(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 9, F.lit(0)).alias("etf_id"), F.when(k == 1, 0.0).when(k == 2, 1e17).when(k > 2, F.col("o_totalprice")).alias("nav"), F.to_date("o_orderdate").alias("trade_date"))
    return _gate(x, Q.nav_rules(MAX), "o_orderkey")


@query("gate_profile", _sql("SELECT c_custkey, nullif(c_custkey % 9, 0) AS e, nullif(c_nationkey, 3) AS m, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_name END AS n FROM customer", "c_custkey", {"missing_fund": "e IS NULL", "missing_market": "m IS NULL", "missing_name": "trim(n) = ''"}))
def _(spark, sf):
    c = F.col("c_custkey")
    x = t(spark, sf, "customer").select("c_custkey", F.nullif(c % 9, F.lit(0)).alias("etf_id"), F.nullif("c_nationkey", F.lit(3)).alias("market"), F.when(c % 4 == 0, "  ").otherwise(F.col("c_name")).alias("display_name"))
    return _gate(x, Q.profile_rules(), "c_custkey")


@query(
    "gate_news",
    _sql(
        "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS title, CASE doc_id % 5 WHEN 0 THEN 'soon' WHEN 1 THEN '2031-05-01 10:00:00' ELSE '1999-05-01 10:00:00' END AS p, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'http://x' END AS url, source AS publisher FROM documents",
        "doc_id",
        {"missing_title": "trim(title) = ''", "unparsed_date": "p = 'soon'", "implausible_date": "p LIKE '2031%'"},
        {"missing_url": "url IS NULL", "missing_publisher": "trim(publisher) = ''"},
    ),
)
def _(spark, sf):
    d = F.col("doc_id")
    x = t(spark, sf, "documents").select("doc_id", F.when(d % 7 == 0, "").otherwise(F.col("text")).alias("title"), F.when(d % 5 == 0, "soon").when(d % 5 == 1, "2031-05-01 10:00:00").otherwise("1999-05-01 10:00:00").alias("published_at"), F.when(d % 3 != 0, "http://x").alias("url"), F.col("source").alias("publisher"))
    return _gate(x, Q.news_rules(MAX), "doc_id")


@query(
    "gate_supply_fact",
    _sql(
        "SELECT l_orderkey, l_linenumber, nullif(l_orderkey % 50, 0) AS id, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'acme' END AS party, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_extendedprice END AS amount, CASE WHEN l_suppkey % 4 < 2 THEN NULL ELSE l_quantity * 30 END AS ratio, CAST(l_shipdate AS DATE) AS d, l_returnflag = 'R' AS withheld FROM lineitem",
        "l_orderkey, l_linenumber",
        {"missing_id": "id IS NULL", "date_out_of_range": f"d > {M}", "empty_parse": "party IS NULL AND amount IS NULL AND ratio IS NULL"},
        {"counterparty_withheld": "withheld", "missing_amount": "amount IS NULL", "ratio_out_of_range": "ratio > 1000"},
    ),
)
def _(spark, sf):
    k, s = F.col("l_orderkey"), F.col("l_suppkey") % 4
    x = t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(k % 50, F.lit(0)).alias("rcept_no"), F.when(k % 3 != 0, "acme").alias("counterparty"), F.when(s != 0, F.col("l_extendedprice")).alias("amount"), F.when(s >= 2, F.col("l_quantity") * 30).alias("ratio_pct"),
        F.to_date("l_shipdate").alias("report_date"), (F.col("l_returnflag") == "R").alias("counterparty_withheld"),
    )
    return _gate(x, Q.supply_rules(MAX), "l_orderkey", "l_linenumber")


@query(
    "gate_segment_fact",
    _sql(
        "SELECT l_orderkey, l_linenumber, l_orderkey AS id, CASE WHEN l_partkey % 6 = 0 THEN ' ' ELSE 'seg' END AS seg, CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE l_extendedprice END AS rev, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_quantity * 3 END AS share, CAST(l_shipdate AS DATE) AS d FROM lineitem",
        "l_orderkey, l_linenumber",
        {"missing_segment": "trim(seg) = ''", "date_out_of_range": f"d > {M}", "no_amounts": "rev IS NULL AND share IS NULL"},
        {"share_out_of_range": "share > 100"},
    ),
)
def _(spark, sf):
    s = F.col("l_suppkey")
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("rcept_no"), F.when(F.col("l_partkey") % 6 == 0, " ").otherwise("seg").alias("segment_name"), F.when(s % 2 != 0, F.col("l_extendedprice")).alias("revenue"), F.when(s % 4 != 0, F.col("l_quantity") * 3).alias("revenue_share_pct"), F.to_date("l_shipdate").alias("report_date"))
    return _gate(x, Q.segment_rules(MAX), "l_orderkey", "l_linenumber")


@query("gate_flow", _sql("SELECT event_id, nullif(user_id, 9) AS ticker, nullif(event_type, 'view') AS net_foreign, nullif(props, '{\"k\": 9}') AS net_fund FROM events", "event_id", {"missing_ticker": "ticker IS NULL", "missing_net_foreign": "net_foreign IS NULL"}, {"missing_net_fund": "net_fund IS NULL"}))
def _(spark, sf):
    x = t(spark, sf, "events").select("event_id", F.nullif("user_id", F.lit(9)).alias("ticker"), F.nullif("event_type", F.lit("view")).alias("net_foreign"), F.nullif("props", F.lit('{"k": 9}')).alias("net_fund"))
    return _gate(x, Q.flow_rules(["net_foreign"], ["net_fund"]), "event_id")


@query(
    "gate_load_price",
    _sql("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -value WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE value END AS close, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE value END AS adj, user_id - 10 AS volume FROM events", "event_id", {"bad_close": "close IS NULL OR isnan(close) OR close <= 0", "bad_adjusted": "adj IS NOT NULL AND adj <= 0", "negative_volume": "volume < 0"}),
)
def _(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    x = t(spark, sf, "events").select("event_id", F.when(k % 5 == 1, -v).when(k % 5 == 2, float("nan")).when(k % 5 > 2, v).alias("close"), F.when(k % 3 == 1, 0.0).when(k % 3 == 2, v).alias("adj_close"), (F.col("user_id") - 10).alias("volume"))
    return _gate(x, Q.load_price_rules(), "event_id")


@query("gate_flow_load", _sql("SELECT l_orderkey, l_linenumber, nullif(l_suppkey, 5) AS ticker, l_quantity / 2 AS q FROM lineitem", "l_orderkey, l_linenumber", {"missing_ticker": "ticker IS NULL", "fraction_q": "q <> floor(q)"}))
def _(spark, sf):
    return _gate(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_suppkey", F.lit(5)).alias("ticker"), (F.col("l_quantity") / 2).alias("q")), Q.flow_load_rules(["q"]), "l_orderkey", "l_linenumber")


_OLD = "SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS v FROM orders"


def _old_new(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("v"))
    one = lambda df: df.groupBy("k").agg(F.max_by(F.struct("id", "ts", "v"), F.struct("ts", "id")).alias("x")).select("k", "x.*")
    return one(o.where("id % 2 = 0")), one(o.where("id % 2 = 1"))


_LAST = f"a AS (SELECT *, id % 2 AS is_new FROM ({_OLD}) QUALIFY row_number() OVER (PARTITION BY k, id % 2 ORDER BY ts DESC, id DESC) = 1)"


@query("merge_latest", f"WITH {_LAST} SELECT k, id, v FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, is_new DESC) = 1")
def _(spark, sf):
    return Q.merge_latest(*_old_new(spark, sf), ["k"], "ts").select("k", "id", "v")


@query("merge_exclusive_vendor", f"WITH {_LAST}, c AS (SELECT k FROM a GROUP BY 1 HAVING count(DISTINCT v) > 1) SELECT k, id, v FROM a WHERE k NOT IN (SELECT k FROM c) QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, is_new DESC) = 1")
def _(spark, sf):
    return Q.merge_exclusive_vendor(*_old_new(spark, sf), ["k"], "v", "ts")[0].select("k", "id", "v")


@query("merge_union_mentions", f"WITH {_LAST} SELECT k, arg_max(id, (ts, is_new)) AS id, array_to_string(list_sort(list(DISTINCT v)), ',') AS mentions FROM a GROUP BY 1")
def _(spark, sf):
    old, new = (df.select("k", "id", "ts", F.array("v").alias("mentions")) for df in _old_new(spark, sf))
    return Q.merge_union_mentions(old, new, ["k"], "ts").select("k", "id", F.array_join("mentions", ",").alias("mentions"))


@query("board_collisions", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS boards FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _(spark, sf):
    return Q.board_collisions(t(spark, sf, "orders"), "o_custkey", "o_orderstatus").withColumn("boards", F.array_join("boards", ","))


@query(
    "verify_intraday",
    f"""WITH {PRICES}, n AS (SELECT symbol, trade_date, count(*) AS n FROM bars GROUP BY ALL), m AS (SELECT trade_date, n AS modal_bars FROM (SELECT trade_date, n, count(*) AS c FROM n GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY c DESC, n DESC) = 1)
    SELECT trade_date, CAST(0 AS BIGINT) AS duplicates, any_value(modal_bars) AS modal_bars, round(avg(CASE WHEN n < 0.9 * modal_bars THEN 1 ELSE 0 END), 6) AS partial_share, count(*) AS joined, CAST(0 AS BIGINT) AS mismatched, avg(CASE WHEN n < 0.9 * modal_bars THEN 1 ELSE 0 END) <= 0.4 AS ok FROM n JOIN m USING (trade_date) GROUP BY 1""",
)
def _(spark, sf):
    return Q.verify_intraday(bars(spark, sf), prices(spark, sf), 0.9, 0.4).withColumn("partial_share", F.round("partial_share", 6))


@query("truncation_check", "SELECT c_custkey, min(o_orderdate) AS reached, min(o_orderdate) IS NULL OR min(o_orderdate) > TIMESTAMP '1995-06-01' AS truncated FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf):
    req = t(spark, sf, "customer").select("c_custkey", F.lit(dt.datetime(1995, 6, 1)).alias("since"))
    return Q.truncation_check(t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), req, "c_custkey", "o_orderdate", "since").select("c_custkey", "reached", "truncated")


@query("unfilled_days", "WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date FROM orders), p AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, count(*) FILTER (l_returnflag <> 'N') AS f FROM lineitem GROUP BY 1) SELECT trade_date, CASE WHEN f IS NULL THEN 'MISSING' ELSE 'CONTESTED' END AS state FROM s LEFT JOIN p USING (trade_date) WHERE f IS NULL OR f > 0")
def _(spark, sf):
    s = t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("trade_date"))
    p = t(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"), F.col("l_returnflag").alias("source_vendor"))
    return Q.unfilled_days(s, p, "N")


_W = "w AS (SELECT user_id % 10 AS session_id, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + CASE WHEN min(event_id) % 9 = 0 THEN INTERVAL 30 MINUTE ELSE INTERVAL 1 HOUR END AS window_end, CASE WHEN bool_or(event_type = 'error' AND event_id % 3 = 0) THEN 'INVALID' WHEN min(event_id) % 7 = 0 THEN 'DUE' ELSE 'VALID' END AS status, count(*) AS n FROM events GROUP BY 1, 2)"


def hours(spark, sf):
    h = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    g = t(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("session_id"), h.alias("window_start")).agg(F.min("event_id").alias("m"), F.bool_or((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("bad"), F.count("*").alias("n"))
    end = F.col("window_start") + F.when(F.col("m") % 9 == 0, F.expr("INTERVAL 30 MINUTES")).otherwise(F.expr("INTERVAL 60 MINUTES"))
    return g.select("session_id", "window_start", end.alias("window_end"), F.when(F.col("bad"), "INVALID").when(F.col("m") % 7 == 0, "DUE").otherwise("VALID").alias("status"), "n")


@query(
    "plan_contiguity",
    f"""WITH {_W}, j AS (SELECT *, lag(window_end) OVER (PARTITION BY session_id ORDER BY window_start) AS p FROM w)
    SELECT session_id, count(*) AS n, count(*) FILTER (window_end - window_start <> INTERVAL 1 HOUR) AS wrong_span, count(*) FILTER (p IS NOT NULL AND p <> window_start) AS gaps, min(window_start) AS first, max(window_end) AS last FROM j GROUP BY 1""",
)
def _(spark, sf):
    return Q.plan_contiguity(hours(spark, sf), 3600)


@query("session_checksum", f"WITH {_W} SELECT session_id, sha256(array_to_string(list_sort(list('{{\"n\":' || n || ',\"status\":\"' || status || '\"}}')), chr(10))) AS checksum FROM w GROUP BY 1")
def _(spark, sf):
    return Q.session_checksum(hours(spark, sf), ["n", "status"])


@query(
    "session_qc",
    f"""WITH {_W}, h AS (SELECT session_id, min(window_start) FILTER (status <> 'VALID') AS hole, max(window_end) FILTER (status <> 'DUE') AS processed_through FROM w GROUP BY 1)
    SELECT w.session_id, count(*) AS windows, count(*) FILTER (status = 'VALID') AS valid, any_value(processed_through) AS processed_through, max(window_end) FILTER (status = 'VALID' AND (hole IS NULL OR window_start < hole)) AS contiguous_through FROM w JOIN h USING (session_id) GROUP BY 1""",
)
def _(spark, sf):
    w = hours(spark, sf)
    n = w.groupBy("session_id").agg(F.count("*").alias("windows"), F.count_if(F.col("status") == "VALID").alias("valid"))
    return n.join(Q.dual_watermark(w), "session_id")


@query("dual_watermark", f"WITH {_W}, h AS (SELECT session_id, min(window_start) FILTER (status <> 'VALID') AS hole, max(window_end) FILTER (status <> 'DUE') AS processed_through FROM w GROUP BY 1) SELECT w.session_id, any_value(processed_through) AS processed_through, max(window_end) FILTER (status = 'VALID' AND (hole IS NULL OR window_start < hole)) AS contiguous_through FROM w JOIN h USING (session_id) GROUP BY 1")
def _(spark, sf):
    return Q.dual_watermark(hours(spark, sf))


@query("confirm_missing", f"WITH {_W} SELECT session_id, window_start, CASE WHEN status = 'DUE' AND window_end <= TIMESTAMP '2024-01-15 00:00:00' THEN 'MISSING' ELSE status END AS status FROM w")
def _(spark, sf):
    return Q.confirm_missing(hours(spark, sf), dt.datetime(2024, 1, 15), scheduled="window_end").select("session_id", "window_start", "status")


@query("late_correction", "SELECT user_id, event_type, max(event_id) AS generation, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    return Q.late_correction(t(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("generation"), "value"), ["user_id", "event_type"])


@query("needs_retag", "SELECT doc_id, md5(text) AS fp FROM documents WHERE NOT (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND lang = 'en'))")
def _(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.md5("text").alias("fp"), F.lit(2).alias("version"), "lang")
    done = d.where("doc_id % 3 = 0 OR (doc_id % 3 = 1 AND lang = 'en')").select("doc_id", "fp", "version").union(d.where("doc_id % 3 = 2").select("doc_id", "fp", F.lit(1)))
    return Q.needs_retag(d, done, ["doc_id", "fp", "version"]).select("doc_id", "fp")


@query(
    "screen_items",
    """WITH x AS (SELECT doc_id, contains(lower(text), 'licensed under') AS b, doc_id % 4 < 2 AS s, (doc_id % 10) / 10.0 < 0.3 AS c, lang = 'fr' AS u FROM documents)
    SELECT doc_id, CASE WHEN b THEN 'BLOCKED' WHEN s OR c OR u THEN 'REVIEW_REQUIRED' ELSE 'AUTO_PUBLISHED' END AS decision, concat_ws(',', CASE WHEN b THEN 'banned:licensed under' END, CASE WHEN s THEN 'few_sources' END, CASE WHEN c THEN 'low_confidence' END, CASE WHEN u THEN 'uncertain_kind' END) AS rules FROM x""",
)
def _(spark, sf):
    x = t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", (F.col("doc_id") % 4).alias("n_sources"), (F.col("doc_id") % 10 / 10.0).alias("confidence"), F.col("lang").alias("kind"))
    return Q.screen_items(x, ["licensed under"], 2, 0.3, ["fr"]).select(F.col("item_id").alias("doc_id"), "decision", F.array_join("rules", ",").alias("rules"))


@query("evidence_dedup", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(spark, sf):
    return t(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query(
    "outlier_days",
    """WITH o AS (SELECT event_type AS output, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT * FROM o WHERE day <> DATE '2024-01-15' AND isodow(day) <= 5), l AS (SELECT *, median(n) OVER w AS baseline, count(*) OVER w AS k FROM b WINDOW w AS (PARTITION BY output ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
    SELECT output, day, n, baseline FROM l WHERE k = 4 AND (n > 1.2 * baseline OR n < baseline / 1.2)""",
)
def _(spark, sf):
    o = t(spark, sf, "events").groupBy(F.col("event_type").alias("output"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return Q.outlier_days(o, spark.sql("SELECT DATE '2024-01-15' AS day"), 4, 1.2)


@query(
    "fact_rules",
    """WITH f AS (SELECT o_orderkey AS run_id, o_custkey AS target, o_totalprice > 400000 AS a, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS b, o_orderstatus = 'P' AS c FROM orders),
    v AS (SELECT run_id, target, 'R01_big' AS rule FROM f WHERE a UNION ALL SELECT run_id, target, 'R02_empty' FROM f WHERE b UNION ALL SELECT run_id, target, 'R03_partial' FROM f WHERE c)
    SELECT v.run_id, v.target, v.rule, CASE WHEN v.rule = 'R03_partial' THEN CASE WHEN b THEN 'R02_empty' END WHEN v.rule = 'R01_big' THEN CASE WHEN c THEN 'R03_partial' END END AS explained_by FROM v JOIN f USING (run_id)""",
)
def _(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("has")).distinct()
    f = t(spark, sf, "orders").join(li, "o_orderkey", "left").withColumnsRenamed({"o_orderkey": "run_id", "o_custkey": "target"})
    rules = [Q.Rule("R01_big", F.col("o_totalprice") > 400000), Q.Rule("R02_empty", F.col("has").isNull()), Q.Rule("R03_partial", F.col("o_orderstatus") == "P", blocking=False)]
    return Q.fact_rules(f, rules, [("R03_partial", "R02_empty"), ("R01_big", "R03_partial")]).select("run_id", "target", "rule", "explained_by")


@query(
    "claim_direction_check",
    """WITH c AS (SELECT o_orderkey AS claim_id, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS direction FROM orders), s AS (SELECT l_orderkey AS claim_id, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 END AS sign FROM lineitem WHERE l_linestatus = 'F'),
    g AS (SELECT claim_id, bool_or(sign = direction) AS f, bool_or(sign = -direction) AS a FROM s JOIN c USING (claim_id) WHERE sign IS NOT NULL GROUP BY 1) SELECT claim_id, CASE WHEN coalesce(a, false) THEN 'CONTRADICTED' WHEN coalesce(f, false) THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict FROM c LEFT JOIN g USING (claim_id)""",
)
def _(spark, sf):
    c = t(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1).alias("direction"))
    s = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).alias("sign"), (F.col("l_linestatus") == "F").alias("measured"))
    return Q.claim_direction_check(c, s).select("claim_id", "verdict")


@query(
    "set_partition_check",
    "WITH g AS (SELECT user_id AS unit, count(DISTINCT event_type) AS n FROM events WHERE event_type <> 'view' GROUP BY 1), e AS (SELECT c_custkey AS unit FROM customer WHERE c_custkey BETWEEN 20 AND 200) SELECT count(*) FILTER (n IS NULL) AS dropped, count(*) FILTER (e.unit IS NULL) AS extra, count(*) FILTER (n > 1) AS duplicated FROM e FULL JOIN g ON e.unit = g.unit",
)
def _(spark, sf):
    c = t(spark, sf, "events").where("event_type <> 'view'").select(F.col("user_id").alias("unit"), F.col("event_type").alias("class"))
    return Q.set_partition_check(c, t(spark, sf, "customer").where("c_custkey BETWEEN 20 AND 200").select(F.col("c_custkey").alias("unit")))
