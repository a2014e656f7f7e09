"""Universes, item series, fields from texts, and statistics that build on matched pairs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import events as V
from marketlens.operators import stats as S
from marketlens.operators import universe as N
from marketlens.registry import query

from .bindings import BARS, DAY, HOLDINGS, PRICES, RETURNS, SECTORS, bars, holdings, prices, returns, t
from .events_q import CALIPERS, panel
from .stats_q import flips

_DECL = "decl AS (SELECT DISTINCT o_custkey % 50 AS fund FROM orders), refs AS (SELECT 120 + r_regionkey AS fund FROM region)"
_MEM = f"{HOLDINGS}, {_DECL}, f AS (SELECT DISTINCT fund AS id FROM decl WHERE fund IN (SELECT fund FROM holdings)), m AS (SELECT DISTINCT constituent AS id FROM holdings WHERE fund IN (SELECT id FROM f) AND constituent NOT IN (SELECT fund FROM decl) AND constituent NOT IN (SELECT fund FROM refs)), u AS (SELECT id, 'FUND' AS kind FROM f UNION ALL SELECT id, 'CONSTITUENT' FROM m)"


def _universe(spark, sf):
    decl = t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("fund")).distinct()
    refs = t(spark, sf, "region").select((120 + F.col("r_regionkey")).cast("long").alias("fund"))
    return holdings(spark, sf), decl, refs


@query("universe_build", f"WITH {_MEM} SELECT id, kind, (SELECT md5(count(*) || ':' || sum(('0x' || substr(md5(kind || ':' || id), 1, 12))::HUGEINT)) FROM u) AS version FROM u")
def _(spark, sf):
    return N.universe_build(*_universe(spark, sf))


@query("universe_errors", f"WITH {HOLDINGS}, {_DECL} SELECT fund AS id, 'ORPHAN' AS error FROM decl WHERE fund NOT IN (SELECT fund FROM holdings) UNION ALL SELECT fund, 'OVERLAP' FROM decl WHERE fund IN (SELECT constituent FROM holdings)")
def _(spark, sf):
    h, d, _ = _universe(spark, sf)
    return N.universe_errors(h, d)


@query("membership_loss", f"WITH {HOLDINGS} SELECT DISTINCT fund, constituent FROM holdings WHERE as_of_date = DATE '1996-01-01' AND (fund, constituent) NOT IN (SELECT (fund, constituent) FROM holdings WHERE as_of_date = DATE '1997-01-01')")
def _(spark, sf):
    h = holdings(spark, sf)
    return N.membership_loss(h.where("as_of_date = DATE '1996-01-01'"), h.where("as_of_date = DATE '1997-01-01'"), ["fund", "constituent"])


@query("newcomers", f"WITH {PRICES}, u AS (SELECT c_custkey AS symbol FROM customer), l AS (SELECT DISTINCT symbol FROM prices WHERE trade_date = DATE '{DAY}'), d AS (SELECT symbol, count(DISTINCT trade_date) AS n FROM prices GROUP BY 1) SELECT u.symbol, CASE WHEN l.symbol IS NULL THEN 'NEW' ELSE 'SHALLOW' END AS state FROM u LEFT JOIN l USING (symbol) LEFT JOIN d USING (symbol) WHERE l.symbol IS NULL OR n < 27")
def _(spark, sf):
    p = prices(spark, sf)
    u = t(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"))
    return N.newcomers(u, p.where(F.col("trade_date") == F.lit(DAY)), p, 27)


@query("backfill_subtract", "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id FROM events) SELECT event_id FROM e WHERE event_id % 2 = 0 AND (user_id, d) NOT IN (SELECT (user_id, d) FROM e WHERE event_id % 2 = 1)")
def _(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("d"))
    return N.backfill_subtract(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "d"]).select("event_id")


@query("item_series_rank", "WITH l AS (SELECT year(o_orderdate) AS fiscal_year, o_orderpriority AS ticker, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2), p AS (SELECT ticker, cume_dist() OVER (ORDER BY value) AS last_pct FROM l WHERE fiscal_year = (SELECT max(fiscal_year) FROM l)) SELECT fiscal_year, ticker, value, round(last_pct, 6) AS last_pct FROM l LEFT JOIN p USING (ticker)")
def _(spark, sf):
    wide = t(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("fiscal_year")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.count("o_orderkey").cast("double"))
    return N.item_series_rank(wide).withColumn("last_pct", F.round("last_pct", 6))


@query(
    "window_shares",
    f"""WITH {BARS}, b AS (SELECT symbol, ts, close, CASE WHEN ts >= TIMESTAMP '2024-01-20 16:00:00' THEN 2 WHEN ts >= TIMESTAMP '2024-01-20 08:00:00' THEN 1 ELSE 0 END AS span FROM bars WHERE trade_date = DATE '{DAY}'),
    e AS (SELECT symbol, span, arg_max(close, ts) AS e, arg_min(close, ts) AS f FROM b GROUP BY 1, 2), r AS (SELECT symbol, span, ln(e / coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY span), f)) AS x FROM e) SELECT symbol, CAST(span AS BIGINT) AS span, round(x, 9) AS span_return, round(sum(x) OVER (PARTITION BY symbol), 9) AS day_return FROM r""",
)
def _(spark, sf):
    s = bars(spark, sf).where(F.col("trade_date") == F.lit(DAY)).select("symbol").distinct()
    cuts = s.select("symbol", F.explode(F.array(F.lit(dt.datetime(2024, 1, 20, 8)), F.lit(dt.datetime(2024, 1, 20, 16)))).alias("cut"))
    return N.window_shares(bars(spark, sf), cuts, DAY).select("symbol", "span", F.round("span_return", 9).alias("span_return"), F.round("day_return", 9).alias("day_return"))


@query("parse_amounts", "SELECT o_orderkey, CAST((o_custkey % 90 + 10) * 100000000 AS DOUBLE) AS first, CAST(o_orderkey AS DOUBLE) AS second, true AS approx FROM orders")
def _(spark, sf):
    text = F.concat(F.lit("2024년 약 "), (F.col("o_custkey") % 90 + 10).cast("string"), F.lit("억원, "), F.format_number("o_orderkey", 0), F.lit(" 원"))
    out = N.parse_amounts(t(spark, sf, "orders").withColumn("text", text), "text")
    return out.select("o_orderkey", F.col("amounts")[0]["value"].alias("first"), F.col("amounts")[1]["value"].alias("second"), F.col("amounts")[0]["approx"].alias("approx"))


@query("extract_html_fields", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title_text FROM pages")
def _(spark, sf):
    return N.extract_html_fields(t(spark, sf, "pages"), ["title"]).select("page_id", "title_text")


@query(
    "spillover_att",
    f"""WITH {RETURNS}, {SECTORS}, ow AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS trade_date FROM events WHERE event_type = 'purchase' AND value > 60), us AS (SELECT DISTINCT user_id AS u FROM events),
    nb AS (SELECT DISTINCT dst AS symbol, trade_date FROM ow JOIN (SELECT u AS src, u + 1 AS dst FROM us UNION SELECT u + 1, u FROM us) ON src = symbol WHERE trade_date >= DATE '2024-01-01'), tn AS (SELECT * FROM nb ANTI JOIN ow USING (symbol, trade_date)),
    pan AS (SELECT symbol, trade_date, close, r, sector, ln_size FROM abnormal JOIN sectors USING (symbol) WHERE r IS NOT NULL), tr AS (SELECT pan.* FROM pan JOIN tn USING (symbol, trade_date)), po AS (SELECT pan.* FROM pan ANTI JOIN tn USING (symbol, trade_date) ANTI JOIN ow USING (symbol, trade_date)),
    cand AS (SELECT t.trade_date, t.sector, t.symbol AS t_symbol, c.symbol AS c_symbol, t.r AS t_r, c.r AS c_r, t.close AS t_close, c.close AS c_close, t.ln_size AS t_ln_size, c.ln_size AS c_ln_size, abs(t.ln_size - c.ln_size) / 0.5 + abs(t.close - c.close) / 15.0 AS distance FROM tr t JOIN po c ON t.trade_date = c.trade_date AND t.sector = c.sector AND abs(t.ln_size - c.ln_size) <= 0.5 AND abs(t.close - c.close) <= 15.0),
    mt AS (SELECT *, concat_ws('|', t_symbol, c_symbol, trade_date) AS k, t_r - c_r AS diff FROM cand QUALIFY row_number() OVER (PARTITION BY trade_date, sector, t_symbol ORDER BY distance, c_symbol) <= 2), {flips("mt", "sector", 100)},
    sm AS (SELECT sector, greatest(abs(avg(t_close) - avg(c_close)) / nullif(sqrt((var_samp(t_close) + var_samp(c_close)) / 2), 0), abs(avg(t_ln_size) - avg(c_ln_size)) / nullif(sqrt((var_samp(t_ln_size) + var_samp(c_ln_size)) / 2), 0)) AS m FROM mt GROUP BY 1)
    SELECT sector, att, n_pairs, round(p_value, 6) AS p_value, round(m, 6) AS max_smd FROM flipped JOIN sm USING (sector)""",
)
def _(spark, sf):
    """Neighbours (the next user) of users with large purchases, matched with users that are neither."""
    e = t(spark, sf, "events").where("event_type = 'purchase' AND value > 60").select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("d"), "event_type")
    users = t(spark, sf, "events").select("user_id").distinct()
    edges = users.select(F.col("user_id").alias("src"), (F.col("user_id") + 1).alias("dst"), F.lit("next").alias("link_type"), F.lit(dt.date(2024, 1, 1)).alias("link_date"))
    near = V.spillover_treated(e, edges, "purchase", "next").select(F.col("entity_id").alias("symbol"), F.col("d").alias("trade_date"))
    own = e.select(F.col("entity_id").alias("symbol"), F.col("d").alias("trade_date")).distinct()
    p = panel(spark, sf).where("r IS NOT NULL")
    pool = V.control_pool(V.control_pool(p, near, ["symbol", "trade_date"]), own, ["symbol", "trade_date"])
    m = V.caliper_match(p.join(near, ["symbol", "trade_date"], "left_semi"), pool, ["trade_date", "sector"], CALIPERS, 2)
    rs = p.select("symbol", "trade_date", "r")
    m = m.join(rs.select(F.col("symbol").alias("t_symbol"), "trade_date", F.col("r").alias("t_r")), ["t_symbol", "trade_date"]).join(rs.select(F.col("symbol").alias("c_symbol"), "trade_date", F.col("r").alias("c_r")), ["c_symbol", "trade_date"])
    return S.matched_att(m, ["ln_size", "close"], ["t_symbol", "c_symbol", "trade_date"], perms=100).withColumns({c: F.round(c, 6) for c in ("att", "p_value", "max_smd")})


@query("market_source", f"WITH {RETURNS}, h AS (SELECT trade_date, avg(r) FILTER (symbol % 2 = 0) AS y, avg(r) FILTER (symbol % 2 = 1) AS f FROM returns GROUP BY 1), l AS (SELECT trade_date, y, lag(f) OVER (ORDER BY trade_date) AS x FROM h) SELECT CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 5) AS slope FROM l WHERE trade_date <= DATE '2024-01-28' AND y IS NOT NULL")
def _(spark, sf):
    """The share of one half's daily return that the other half's last session before it explains."""
    from marketlens.operators import pit

    r = returns(spark, sf)
    home = r.where("symbol % 2 = 0").groupBy("trade_date").agg(F.avg("r").alias("y")).where("trade_date <= DATE '2024-01-28' AND y IS NOT NULL")
    away = r.where("symbol % 2 = 1").groupBy(F.col("trade_date").alias("session")).agg(F.avg("r").alias("x"))
    j = pit.asof_join_cross_calendar(home, away, "trade_date", "session", ["session", "x"])
    return S.slope_ci(j.withColumn("all", F.lit(1)), "x", "y", ["all"]).select("n", F.round("slope", 5).alias("slope"))
