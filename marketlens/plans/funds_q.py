"""Funds: customers (mod 40) as funds, parts (mod 150) as constituents, users as traded symbols."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import funds as U
from marketlens.operators import pit
from marketlens.registry import query
from marketlens.sources.sink import written

from .bindings import DAY, HOLDINGS, MIN_N, RETURNS, SECTORS, holdings, prices, returns, sectors
from .panel_q import _NAV, nav_and_price

D = f"DATE '{DAY}'"
SNAP = dt.date(1998, 7, 1)
_H = f"{HOLDINGS}, hold AS (SELECT fund, constituent, weight FROM holdings WHERE as_of_date <= DATE '{SNAP}' QUALIFY as_of_date = max(as_of_date) OVER (PARTITION BY fund))"
_R = f"{RETURNS}, ret AS (SELECT symbol AS constituent, r, volume FROM returns WHERE trade_date = {D})"


def _hold(spark, sf):
    return pit.snapshot_as_of(holdings(spark, sf), ["fund"], "as_of_date", SNAP).select("fund", "constituent", "weight")


def _ret(spark, sf):
    return returns(spark, sf).where(F.col("trade_date") == F.lit(DAY)).select("symbol", "r", "volume")


def _r(df, *cols, n=9):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


@query("weighted_proxy", f"WITH {_H}, {_R} SELECT fund, round(sum(weight * r) / sum(weight) FILTER (r IS NOT NULL), 9) AS proxy, round(coalesce(sum(weight) FILTER (r IS NOT NULL), 0) / sum(weight), 9) AS coverage FROM hold LEFT JOIN ret USING (constituent) GROUP BY 1")
def _(spark, sf):
    return _r(U.weighted_proxy(_hold(spark, sf), _ret(spark, sf)), "proxy", "coverage")


@query("daily_trigger", f"WITH {_H}, {_R}, p AS (SELECT fund, sum(weight * r) / sum(weight) FILTER (r IS NOT NULL) AS proxy, sum(weight) FILTER (r IS NOT NULL) / sum(weight) AS coverage FROM hold LEFT JOIN ret USING (constituent) GROUP BY 1) SELECT fund, round(proxy, 9) AS proxy, round(coverage, 9) AS coverage, 'coverage=' || printf('%.2f', coverage) AS reason FROM p WHERE abs(proxy) >= 1")
def _(spark, sf):
    return _r(U.daily_trigger(_hold(spark, sf), _ret(spark, sf), 1.0), "proxy", "coverage")


@query(
    "fund_decomposition",
    f"""WITH {_H}, {_R}, c AS (SELECT fund, constituent, weight, r, weight * r AS c, row_number() OVER (PARTITION BY fund ORDER BY abs(weight * r) DESC NULLS LAST, constituent) AS k FROM hold LEFT JOIN ret USING (constituent))
    SELECT fund, round(sum(c), 9) AS contribution, round(sum(abs(c)) FILTER (k <= 1) / sum(abs(c)), 9) AS top1, round(sum(abs(c)) FILTER (k <= 3) / sum(abs(c)), 9) AS top3, count(*) FILTER (r > 0) AS advancers, count(*) FILTER (r < 0) AS decliners,
    round(coalesce(sum(weight) FILTER (r IS NOT NULL), 0) / sum(weight), 9) AS coverage FROM c GROUP BY 1""",
)
def _(spark, sf):
    return _r(U.fund_decomposition(_hold(spark, sf), _ret(spark, sf)), "contribution", "top1", "top3", "coverage")


@query("portfolio_overlap", f"WITH {_H} SELECT a.fund AS fund_a, b.fund AS fund_b, round(sum(least(a.weight, b.weight)), 9) AS overlap, count(*) AS common FROM hold a JOIN hold b USING (constituent) WHERE a.fund < b.fund GROUP BY 1, 2")
def _(spark, sf):
    return _r(U.portfolio_overlap(_hold(spark, sf)), "overlap")


@query("portfolio_overlap_bound", f"WITH {_H} SELECT a.fund AS fund_a, b.fund AS fund_b, round(sum(least(a.weight, b.weight)), 9) AS overlap, count(*) AS common FROM hold a JOIN hold b USING (constituent) WHERE a.fund < b.fund GROUP BY 1, 2 HAVING sum(least(a.weight, b.weight)) >= 0.2")
def _(spark, sf):
    return _r(U.portfolio_overlap(written(_hold(spark, sf)), least=0.2), "overlap")


_LAYERS = f"""{_H}, {_R}, px AS (SELECT fund, sum(weight * r) / sum(weight) FILTER (r IS NOT NULL) AS fund_return FROM hold LEFT JOIN ret USING (constituent) GROUP BY 1),
ov AS (SELECT a.fund, b.fund AS sector_fund, sum(least(a.weight, b.weight)) AS overlap FROM hold a JOIN hold b USING (constituent) WHERE a.fund <> b.fund GROUP BY 1, 2),
best AS (SELECT ov.fund, sector_fund, p.fund_return AS sector_return FROM ov JOIN px p ON p.fund = sector_fund WHERE overlap <= 0.9 AND overlap >= 0.05 QUALIFY row_number() OVER (PARTITION BY ov.fund ORDER BY round(overlap, 12) DESC, sector_fund) = 1),
mk AS (SELECT avg(r) AS market_return FROM ret),
lay AS (SELECT px.fund, fund_return, 0.9 * market_return AS market, coalesce(0.5 * (sector_return - market_return), 0) AS sector, sector_fund FROM px CROSS JOIN mk LEFT JOIN best ON best.fund = px.fund),
layers AS (SELECT *, fund_return - market - sector AS idio FROM lay)"""


def _inputs(spark, sf):
    """Holdings and returns, which the layers use several times, written once."""
    return written(_hold(spark, sf)), written(_ret(spark, sf))


def _layers(spark, sf, inputs=None):
    h, r = inputs or _inputs(spark, sf)
    own = U.weighted_proxy(h, r).select("fund", F.col("proxy").alias("fund_return"))
    o = U.portfolio_overlap(h, least=0.05 - 1e-9).withColumn("overlap", F.round("overlap", 12))  # what the layers can use
    overlaps = o.select(F.col("fund_a").alias("fund"), F.col("fund_b").alias("sector_fund"), "overlap").union(o.select("fund_b", "fund_a", "overlap"))
    cand = overlaps.select("fund", "sector_fund").join(own.select(F.col("fund").alias("sector_fund"), F.col("fund_return").alias("sector_return")), "sector_fund")
    betas = own.select("fund", F.lit(0.9).alias("beta_market"), F.lit(0.5).alias("beta_sector"))
    return U.layer_accounting(own, r.agg(F.avg("r").alias("market_return")), cand, overlaps, betas)


@query("layer_accounting", f"WITH {_LAYERS} SELECT fund, round(fund_return, 6) AS fund_return, round(market, 6) AS market, round(sector, 6) AS sector, sector_fund, round(idio, 6) AS idio FROM layers")
def _(spark, sf):
    return _r(_layers(spark, sf).select("fund", "fund_return", "market", "sector", "sector_fund", "idio"), "fund_return", "market", "sector", "idio", n=6)


@query(
    "dominant_layer",
    f"""WITH {_LAYERS}, u AS (SELECT fund, name, abs(v) / (abs(market) + abs(sector) + abs(idio)) AS share FROM (SELECT fund, market, sector, idio, unnest(['market', 'sector', 'idio']) AS name, unnest([market, sector, idio]) AS v FROM layers))
    SELECT fund, round(max(share), 6) AS layer_share, CASE WHEN max(share) >= 0.5 THEN arg_max(name, share) ELSE 'MIXED' END AS layer FROM u GROUP BY 1""",
)
def _(spark, sf):
    return _r(U.dominant_layer(_layers(spark, sf)).select("fund", "layer_share", "layer"), "layer_share", n=6)


@query(
    "idio_contributors",
    f"""WITH {_LAYERS}, j AS (SELECT h.fund, constituent, r, volume % 3 = 0 AS halted, weight * (r - market - sector) AS c FROM hold h JOIN ret USING (constituent) JOIN layers l ON l.fund = h.fund),
    n AS (SELECT fund, count(*) FILTER (halted) AS n_halted, count(*) FILTER (NOT halted AND r > 0) AS advancers, count(*) FILTER (NOT halted AND r < 0) AS decliners FROM j GROUP BY 1)
    SELECT fund, constituent, round(c, 6) AS contribution, CAST(row_number() OVER (PARTITION BY fund ORDER BY abs(c) DESC, constituent) AS INT) AS rank, n_halted, advancers, decliners FROM j JOIN n USING (fund) WHERE NOT halted AND c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fund ORDER BY abs(c) DESC, constituent) <= 5""",
)
def _(spark, sf):
    h, r = _inputs(spark, sf)
    return _r(U.idio_contributors(h, r.withColumn("volume", F.col("volume") % 3), _layers(spark, sf, (h, r)), 5), "contribution", n=6)


@query(
    "scope_cover",
    f"""WITH {_H}, {_R}, c AS (SELECT fund, constituent, abs(weight * r) AS s FROM hold JOIN ret USING (constituent) WHERE r IS NOT NULL),
    w AS (SELECT fund, s, coalesce(sum(s) OVER (PARTITION BY fund ORDER BY s DESC, constituent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(s) OVER (PARTITION BY fund) AS a FROM c)
    SELECT fund, count(*) AS n_scopes, round(sum(s) / any_value(a), 6) AS covered FROM w WHERE before < 0.5 * a GROUP BY 1""",
)
def _(spark, sf):
    c = _hold(spark, sf).join(_ret(spark, sf).withColumnRenamed("symbol", "constituent"), "constituent").where("r IS NOT NULL").withColumn("contribution", F.col("weight") * F.col("r"))
    return _r(U.scope_cover(c), "covered", n=6)


@query("sector_mode_weight", f"WITH {_H}, {SECTORS}, s AS (SELECT fund, sector, sum(weight) AS w FROM hold JOIN sectors ON constituent = symbol GROUP BY 1, 2) SELECT fund, sector, round(w / sum(w) OVER (PARTITION BY fund), 9) AS share, w / sum(w) OVER (PARTITION BY fund) >= 0.25 AS dominant FROM s")
def _(spark, sf):
    return _r(U.sector_mode_weight(_hold(spark, sf), sectors(spark, sf).select("symbol", "sector"), 0.25), "share")


@query(
    "premium_split",
    f"""WITH {_NAV}, b AS (SELECT fund, d, close, nav FROM n JOIN p USING (fund, d) WHERE (fund % 10) / 10.0 + 0.3 >= 0.6)
    SELECT fund, d, round(ln(close / lag(close) OVER w), 9) AS fund_return, round(ln(nav / lag(nav) OVER w), 9) AS basket_return, round(ln(close / lag(close) OVER w) - ln(nav / lag(nav) OVER w), 9) AS premium_change FROM b WINDOW w AS (PARTITION BY fund ORDER BY d)""",
)
def _(spark, sf):
    nav, price = nav_and_price(spark, sf)
    b = nav.join(price, ["fund", "d"]).withColumn("coverage", (F.col("fund") % 10) / 10.0 + 0.3)
    return _r(U.premium_split(b, ts="d", basket="nav").select("fund", "d", "fund_return", "basket_return", "premium_change"), "fund_return", "basket_return", "premium_change")


@query(
    "nav_price_join",
    f"""WITH {_NAV}, j AS (SELECT fund, d, close / nav - 1 AS premium FROM n JOIN p USING (fund, d)), w AS (SELECT *, premium - lag(premium) OVER (PARTITION BY fund ORDER BY d) AS c FROM j)
    SELECT fund, d, round(premium, 9) AS premium, round(c, 9) AS premium_change FROM w WHERE month(d) = fund % 12 + 1""",
)
def _(spark, sf):
    nav, price = nav_and_price(spark, sf)
    trig = nav.where(F.month("d") == F.col("fund") % 12 + 1)
    return _r(U.nav_price_join(nav, price, trig).select("fund", "d", "premium", "premium_change"), "premium", "premium_change")


@query("grid_universe", f"WITH {_H}, {RETURNS}, n AS (SELECT DISTINCT constituent FROM (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight DESC, constituent) AS k FROM hold) WHERE k <= 2) SELECT DISTINCT symbol, trade_date FROM returns WHERE symbol IN (SELECT constituent FROM n)")
def _(spark, sf):
    return U.grid_universe(_hold(spark, sf), returns(spark, sf), 2)


@query(
    "basket_path_join",
    f"""WITH {_H}, {RETURNS}, f AS (SELECT symbol % 40 AS fund, trade_date, avg(close) AS fund_close FROM prices GROUP BY ALL), pc AS (SELECT symbol, arg_min(close, trade_date) AS prev_close FROM prices GROUP BY 1),
    b AS (SELECT fund, trade_date, sum(weight * close / prev_close) / sum(weight) AS basket, sum(weight) AS coverage FROM prices JOIN pc USING (symbol) JOIN hold ON constituent = symbol GROUP BY ALL)
    SELECT fund, trade_date, round(fund_close, 6) AS fund_close, round(basket, 6) AS basket, round(coverage, 9) AS coverage FROM f JOIN b USING (fund, trade_date)""",
)
def _(spark, sf):
    p = written(prices(spark, sf).select("symbol", "trade_date", "close"))
    f = p.groupBy((F.col("symbol") % 40).alias("fund"), "trade_date").agg(F.avg("close").alias("fund_close"))
    pc = p.groupBy("symbol").agg(F.min_by("close", "trade_date").alias("prev_close"))
    return _r(_r(U.basket_path_join(f, p, _hold(spark, sf), pc, ts="trade_date"), "fund_close", "basket", n=6), "coverage").select("fund", "trade_date", "fund_close", "basket", "coverage")


@query(
    "loo_layers",
    f"""WITH {RETURNS}, {SECTORS}, j AS (SELECT symbol, trade_date, r, sector FROM returns JOIN sectors USING (symbol) WHERE r IS NOT NULL),
    m AS (SELECT *, (sum(r) OVER d - r) / nullif(count(*) OVER d - 1, 0) AS market, (sum(r) OVER c - r) / nullif(count(*) OVER c - 1, 0) AS own FROM j WINDOW d AS (PARTITION BY trade_date), c AS (PARTITION BY trade_date, sector))
    SELECT symbol, trade_date, round(market, 6) AS market, round(own - market, 6) AS cluster, round(r - own, 6) AS idio FROM m""",
)
def _(spark, sf):
    return _r(U.loo_layers(returns(spark, sf), sectors(spark, sf).select("symbol", "sector")).select("symbol", "trade_date", "market", "cluster", "idio"), "market", "cluster", "idio", n=6)
