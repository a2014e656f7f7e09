"""Event-study statistics on user events and their daily prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import funds as U
from marketlens.operators import panel as P
from marketlens.operators import slopes as K
from marketlens.operators import spectrum as N
from marketlens.operators import stats as S
from marketlens.operators import trees as T
from marketlens.registry import query
from marketlens.sources.sink import written

from .bindings import DAY, MIN_N, RETURNS, SECTORS, prices, returns, sectors, t
from .events_q import MATCH, matched, panel, treated_days

D = f"DATE '{DAY}'"
_E = "ev0 AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS trade_date, event_type FROM events)"


def _events(spark, sf):
    return t(spark, sf, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"), "event_type").distinct()


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("event_panel", f"WITH {RETURNS}, {_E} SELECT symbol, trade_date, round(ar, 6) AS ar FROM abnormal WHERE trade_date < {D} AND (symbol, trade_date) IN (SELECT (symbol, trade_date) FROM ev0 WHERE event_type = 'error')")
def _(spark, sf):
    return _r(S.event_panel(returns(spark, sf), _events(spark, sf), "error", DAY).select("symbol", "trade_date", "ar"), "ar")


_Z = "z AS (SELECT symbol, trade_date, (r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0) AS z FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"


@query("series_panel", f"WITH {RETURNS}, {_Z} SELECT symbol, trade_date, round(z, 3) AS z FROM z WHERE trade_date < {D} AND abs(z) >= 2")
def _(spark, sf):
    z = P.rolling_z(P.daily_returns(prices(spark, sf)), "r", 10, "z")
    return _r(S.series_panel(z, "z", 2.0, DAY).select("symbol", "trade_date", "z"), "z", n=3)


_PAN = f"pan0 AS (SELECT a.symbol, a.trade_date, event_type, ar, close, volume FROM abnormal a JOIN ev0 USING (symbol, trade_date) WHERE trade_date < {D})"


def _typed(spark, sf):
    return returns(spark, sf).join(_events(spark, sf), ["symbol", "trade_date"]).where(F.col("trade_date") < F.lit(DAY))


@query(
    "dose_response",
    f"""WITH {RETURNS}, {_E}, {_PAN}, q AS (SELECT event_type, quantile_cont(close, 0.8) AS q FROM pan0 WHERE ar IS NOT NULL GROUP BY 1)
    SELECT event_type, count(*) FILTER (close > q) AS n_high, count(*) FILTER (close <= q) AS n_low, round(avg(ar) FILTER (close > q) - avg(ar) FILTER (close <= q), 6) AS effect FROM pan0 JOIN q USING (event_type) WHERE ar IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return _r(S.dose_response(_typed(spark, sf), "close", "ar"), "effect")


_STRAT = "lab AS (SELECT *, CASE WHEN symbol % 3 = 0 THEN 1 ELSE 0 END AS d FROM pan0 WHERE ar IS NOT NULL), st AS (SELECT event_type, trade_date FROM lab GROUP BY ALL HAVING sum(d) > 0 AND sum(d) < count(*))"


@query(
    "stratified_permutation",
    f"""WITH {RETURNS}, {_E}, {_PAN}, {_STRAT}, r AS (SELECT event_type, trade_date, d, ar, concat_ws('|', symbol, trade_date) AS k, sum(d) OVER (PARTITION BY event_type, trade_date) AS m FROM lab JOIN st USING (event_type, trade_date)),
    x AS (SELECT event_type, p, ar, row_number() OVER (PARTITION BY event_type, p, trade_date ORDER BY substr(md5(concat_ws('|', 7, (p - 1) // 4, k)), (p - 1) % 4 * 8 + 1, 8), k) <= m AS hi FROM r, range(1, 51) q(p)),
    e AS (SELECT event_type, p, avg(ar) FILTER (hi) - avg(ar) FILTER (NOT hi) AS e FROM x GROUP BY 1, 2),
    o AS (SELECT event_type, CAST(sum(d) AS BIGINT) AS n_treated, count(*) AS n, avg(ar) FILTER (d = 1) - avg(ar) FILTER (d = 0) AS effect FROM r GROUP BY 1)
    SELECT event_type, any_value(n_treated) AS n_treated, any_value(n) AS n, round(any_value(effect), 6) AS effect, round((count(*) FILTER (abs(e) >= abs(effect) - 1e-12) + 1) / 51, 9) AS p_value FROM o JOIN e USING (event_type) GROUP BY 1""",
)
def _(spark, sf):
    p = _typed(spark, sf).withColumn("d", (F.col("symbol") % 3 == 0).cast("int"))
    out = S.stratified_permutation(p, "d", "ar", "trade_date", ["symbol", "trade_date"], perms=50)
    return _r(_r(out, "effect"), "p_value", n=9).select("event_type", "n_treated", "n", "effect", "p_value")


@query("edge_verdict", "WITH x AS (SELECT event_type, count(*) AS n, CASE WHEN count(*) % 3 > 0 THEN (count(*) % 7) / 50.0 END AS p FROM events GROUP BY 1), m AS (SELECT greatest(count(*) FILTER (n >= 100 AND p IS NOT NULL), 1) AS m FROM x) SELECT event_type, n, CASE WHEN n < 100 OR p IS NULL THEN 'UNMEASURABLE' WHEN p <= 0.05 / m THEN 'HOLDS' ELSE 'FAILS' END AS verdict FROM x, m")
def _(spark, sf):
    x = t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("p_value", F.when(F.col("n") % 3 > 0, F.col("n") % 7 / 50.0))
    return S.edge_verdict(x, 100, 0.05).select("event_type", "n", "verdict")


@query("interaction_effect", f"WITH {RETURNS}, {_E}, {_PAN}, c AS (SELECT event_type, ar, symbol % 2 AS d, CASE WHEN close > 50 THEN 1 ELSE 0 END AS c FROM pan0 WHERE ar IS NOT NULL) SELECT event_type, round(avg(ar) FILTER (d = 1 AND c = 1) - avg(ar) FILTER (d = 1 AND c = 0) - avg(ar) FILTER (d = 0 AND c = 1) + avg(ar) FILTER (d = 0 AND c = 0), 6) AS interaction, count(*) AS n FROM c GROUP BY 1")
def _(spark, sf):
    p = _typed(spark, sf).withColumn("d", F.col("symbol") % 2).withColumn("c", (F.col("close") > 50).cast("int"))
    return _r(S.interaction_effect(p, "d", "c", "ar"), "interaction")


@query(
    "condition_today",
    f"""WITH {RETURNS}, p AS (SELECT close FROM returns WHERE trade_date < {D}), td AS (SELECT symbol, close FROM returns WHERE trade_date = {D}), x AS (SELECT symbol, (SELECT count(*) FROM p WHERE p.close <= td.close) / (SELECT count(*) FROM p) AS pct FROM td)
    SELECT symbol, 'close' AS condition, round(pct, 6) AS pct, pct >= 0.8 AS active FROM x""",
)
def _(spark, sf):
    r = returns(spark, sf)
    return _r(S.condition_today(r.where(F.col("trade_date") < F.lit(DAY)), r.where(F.col("trade_date") == F.lit(DAY)), ["close"]), "pct")


def flips(pairs: str, by: str, perms: int) -> str:
    """SQL: att, n_pairs and p_value of sign_flip() for pairs (by, diff, k), as table flipped."""
    return f"""fe AS (SELECT {by}, p, avg(CASE WHEN substr(md5(concat_ws('|', 7, (p - 1) // 32, k)), (p - 1) % 32 + 1, 1) < '8' THEN diff ELSE -diff END) AS e FROM {pairs}, range(1, {perms + 1}) q(p) WHERE diff IS NOT NULL GROUP BY ALL),
    fa AS (SELECT {by}, avg(diff) AS att, count(*) AS n_pairs FROM {pairs} WHERE diff IS NOT NULL GROUP BY ALL),
    flipped AS (SELECT {by}, round(any_value(att), 6) AS att, any_value(n_pairs) AS n_pairs, round((count(*) FILTER (abs(e) >= abs(att) - 1e-12) + 1) / {perms + 1}, 9) AS p_value FROM fa JOIN fe USING ({by}) GROUP BY ALL)"""


@query("matched_att", f"WITH {MATCH}, pr AS (SELECT sector, t_r - c_r AS diff, concat_ws('|', t_symbol, c_symbol, trade_date) AS k FROM matched), {flips('pr', 'sector', 50)} SELECT sector, att, n_pairs, p_value FROM flipped")
def _(spark, sf):
    out = S.matched_att(matched(spark, sf), ["ln_size", "close"], ["t_symbol", "c_symbol", "trade_date"], perms=50)
    return _r(_r(out, "att"), "p_value", n=9).select("sector", "att", "n_pairs", "p_value")


_D0 = "x AS (SELECT r.trade_date, market_mean AS r, ln(sum(volume)) AS ln_vol, avg(close) AS trend FROM returns r JOIN market USING (trade_date) WHERE market_mean IS NOT NULL GROUP BY 1, 2), hit AS (SELECT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) % 3 = 0)"


@query(
    "market_day_att",
    f"""WITH {RETURNS}, {_D0}, m AS (SELECT a.trade_date AS t_day, a.r - b.r AS e, abs(a.ln_vol - b.ln_vol) / 0.5 + abs(a.trend - b.trend) / 20.0 AS dist, b.trade_date AS c_day, b.r AS c_r, a.r AS t_r FROM x a JOIN x b ON dayofweek(a.trade_date) = dayofweek(b.trade_date)
    WHERE a.trade_date IN (SELECT d FROM hit) AND b.trade_date NOT IN (SELECT d FROM hit) AND abs(a.ln_vol - b.ln_vol) <= 0.5 AND abs(a.trend - b.trend) <= 20 QUALIFY row_number() OVER (PARTITION BY a.trade_date ORDER BY dist, c_day) <= 2)
    SELECT t_day, round(any_value(t_r) - avg(c_r), 6) AS effect, count(*) AS n_controls FROM m GROUP BY 1""",
)
def _(spark, sf):
    r = returns(spark, sf)
    m = P.cross_section_mean(r, min_n=1).select("trade_date", F.col("market_mean").alias("r"))
    x = r.groupBy("trade_date").agg(F.log(F.sum("volume")).alias("ln_vol"), F.avg("close").alias("trend")).join(m, "trade_date").where("r IS NOT NULL")
    hit = t(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("trade_date")).agg(F.count("*").alias("n")).where("n % 3 = 0")
    return _r(S.market_day_att(x, hit, 0.5, 20.0, 2), "effect")


@query(
    "stability_split",
    f"""WITH {RETURNS}, {_E}, {_PAN}, m AS (SELECT event_type, quantile_cont(trade_date - DATE '1970-01-01', 0.5) AS m FROM pan0 GROUP BY 1), h AS (SELECT p.*, CASE WHEN trade_date - DATE '1970-01-01' <= m THEN 1 ELSE 2 END AS half FROM pan0 p JOIN m USING (event_type) WHERE ar IS NOT NULL),
    q AS (SELECT event_type, half, quantile_cont(close, 0.8) AS q FROM h GROUP BY 1, 2), d AS (SELECT event_type, half, avg(ar) FILTER (close > q) - avg(ar) FILTER (close <= q) AS e FROM h JOIN q USING (event_type, half) GROUP BY 1, 2)
    SELECT event_type, round(max(e) FILTER (half = 1), 6) AS first, round(max(e) FILTER (half = 2), 6) AS second, sign(max(e) FILTER (half = 1)) = sign(max(e) FILTER (half = 2)) AS same_sign FROM d GROUP BY 1""",
)
def _(spark, sf):
    return _r(S.stability_split(_typed(spark, sf), "close", "ar"), "first", "second")


@query("slope_ci", f"WITH {RETURNS}, j AS (SELECT symbol, r, market_mean AS m FROM returns JOIN market USING (trade_date)), g AS (SELECT symbol, regr_count(r, m) AS n, regr_slope(r, m) AS b, regr_sxx(r, m) AS sxx, regr_syy(r, m) AS syy FROM j GROUP BY 1) SELECT symbol, CAST(n AS BIGINT) AS n, round(b, 4) AS slope, round(sqrt(greatest(syy - b * b * sxx, 0) / (n - 2) / sxx), 4) AS se FROM g WHERE n > 5")
def _(spark, sf):
    r = P.daily_returns(prices(spark, sf))
    m = P.cross_section_mean(r, min_n=1).select("trade_date", F.col("market_mean").alias("m"))
    return _r(S.slope_ci(r.join(m, "trade_date"), "m", "r", ["symbol"]).where("n > 5").select("symbol", "n", "slope", "se"), "slope", "se", n=4)


@query("idio_budget", f"WITH {RETURNS} SELECT symbol, round(ar, 6) AS ar, round((SELECT market_mean FROM market WHERE trade_date = {D}), 6) AS market_mean FROM abnormal WHERE trade_date = {D}")
def _(spark, sf):
    r = returns(spark, sf)
    return _r(S.idio_budget(r, P.cross_section_mean(r, min_n=1), DAY).select("symbol", "ar", "market_mean"), "ar", "market_mean")


@query(
    "additive_budget",
    f"""WITH {RETURNS}, c AS (SELECT symbol, sum(abs(ar)) / 10 AS claimed FROM abnormal WHERE ar IS NOT NULL GROUP BY 1), b AS (SELECT symbol, ar AS budget FROM abnormal WHERE trade_date = {D}), s AS (SELECT symbol, stddev_samp(ar) AS sigma FROM abnormal GROUP BY 1 HAVING count(ar) >= 28)
    SELECT symbol, CASE WHEN sigma IS NULL THEN 'NOT_COMPUTED' WHEN claimed <= abs(budget) + 1.96 * sigma THEN 'WITHIN' ELSE 'EXCEEDS' END AS verdict FROM c JOIN b USING (symbol) LEFT JOIN s USING (symbol)""",
)
def _(spark, sf):
    r = returns(spark, sf)
    sigma = r.groupBy("symbol").agg(F.stddev_samp("ar").alias("sigma"), F.count("ar").alias("n")).where("n >= 28").select("symbol", "sigma")
    claims = r.where("ar IS NOT NULL").select("symbol", (F.col("ar") / 10).alias("att"))
    return S.additive_budget(claims, r.where(F.col("trade_date") == F.lit(DAY)).select("symbol", F.col("ar").alias("budget")), sigma).select("symbol", "verdict")


@query("identification_route", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'POINT' WHEN o_custkey % 3 = 0 THEN 'INTERVAL' WHEN o_orderstatus = 'F' THEN 'EXCLUSION_ONLY' ELSE 'REJECT' END AS route FROM orders")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("point"), (F.col("o_custkey") % 3 == 0).alias("bounds"), (F.col("o_orderstatus") == "F").alias("exclusion"))
    return S.identification_route(o).select("o_orderkey", "route")


@query("return_correlation", f"WITH {RETURNS}, o AS (SELECT symbol, trade_date, r FROM returns WHERE r IS NOT NULL) SELECT a.symbol AS a, b.symbol AS b, round(corr(a.r, b.r), 4) AS rho, count(*) AS n FROM o a JOIN o b USING (trade_date) WHERE a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 20")
def _(spark, sf):
    return _r(S.return_correlation(P.daily_returns(prices(spark, sf)), 20), "rho", n=4)


@query(
    "cluster_stability",
    """WITH j AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b FROM customer), x AS (SELECT sum(n * (n - 1) / 2) AS ab FROM (SELECT count(*) AS n FROM j GROUP BY a, b)), p AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT count(*) AS n FROM j GROUP BY a)), q AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT count(*) AS n FROM j GROUP BY b)), k AS (SELECT count(*) AS n FROM j)
    SELECT n, round((ab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM x, p, q, k""",
)
def _(spark, sf):
    c = t(spark, sf, "customer")
    return _r(S.cluster_stability(c.select("c_custkey", F.col("c_mktsegment").alias("label")), c.select("c_custkey", (F.col("c_nationkey") % 5).alias("label")), key="c_custkey"), "ari")


_LOO = """j AS (SELECT symbol, trade_date, r, sector FROM returns JOIN sectors USING (symbol) WHERE r IS NOT NULL), loo0 AS (SELECT *, (sum(r) OVER d - r) / nullif(count(*) OVER d - 1, 0) AS market, (sum(r) OVER c - r) / nullif(count(*) OVER c - 1, 0) AS own FROM j WINDOW d AS (PARTITION BY trade_date), c AS (PARTITION BY trade_date, sector)),
loo AS (SELECT symbol, trade_date, r, market, own - market AS cluster, r - own AS idio FROM loo0)"""


def _loo(spark, sf):
    return U.loo_layers(returns(spark, sf), sectors(spark, sf).select("symbol", "sector"))


@query("layer_diagnostics", f"WITH {RETURNS}, {SECTORS}, {_LOO}, l AS (SELECT *, lag(idio) OVER (PARTITION BY symbol ORDER BY trade_date) AS p FROM loo) SELECT symbol, round(regr_slope(r, market), 4) AS beta, round(var_pop(market) / var_pop(r), 4) AS market_share, round(var_pop(cluster) / var_pop(r), 4) AS cluster_share, round(corr(market, cluster), 4) AS layer_corr, round(corr(idio, p), 4) AS autocorr FROM l GROUP BY 1 HAVING count(*) >= 10")
def _(spark, sf):
    big = _loo(spark, sf).groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 10").select("symbol")
    return _r(S.layer_diagnostics(_loo(spark, sf).join(big, "symbol", "left_semi")), "beta", "market_share", "cluster_share", "layer_corr", "autocorr", n=4)


@query("beta_cap_vs_equal", f"WITH {RETURNS}, j AS (SELECT symbol, trade_date, r, greatest(c_acctbal, 1) AS w FROM returns JOIN customer ON c_custkey = symbol WHERE r IS NOT NULL), m AS (SELECT trade_date, avg(r) AS eq, sum(r * w) / sum(w) AS cap FROM j GROUP BY 1) SELECT symbol, round(regr_slope(r, cap), 4) AS beta_cap, round(regr_slope(r, eq), 4) AS beta_equal, count(*) AS n FROM j JOIN m USING (trade_date) GROUP BY 1 HAVING count(*) >= 10")
def _(spark, sf):
    w = t(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), F.greatest("c_acctbal", F.lit(1.0)).alias("weight"))
    return _r(S.beta_cap_vs_equal(returns(spark, sf), w).where("n >= 10"), "beta_cap", "beta_equal", n=4)


@query(
    "spike_alignment",
    f"""WITH {RETURNS}, {SECTORS}, {_LOO}, k AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date, count(*) AS n FROM events GROUP BY ALL), x AS (SELECT l.symbol, idio, coalesce(n, 0) AS n FROM loo l LEFT JOIN k USING (symbol, trade_date)), b AS (SELECT symbol, quantile_cont(n, 0.8) AS q, quantile_cont(abs(round(idio, 12)), 0.9) AS e FROM x GROUP BY 1)
    SELECT symbol, round(avg(CASE WHEN n > q THEN 1 ELSE 0 END) FILTER (abs(round(idio, 12)) >= e - 1e-9), 6) AS spike_extreme, round(avg(CASE WHEN n > q THEN 1 ELSE 0 END) FILTER (NOT abs(round(idio, 12)) >= e - 1e-9), 6) AS spike_ordinary FROM x JOIN b USING (symbol) WHERE idio IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    k = t(spark, sf, "events").groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date")).agg(F.count("*").alias("n_articles"))
    return _r(S.spike_alignment(_loo(spark, sf).select("symbol", "trade_date", F.round("idio", 9).alias("idio")).where("idio IS NOT NULL"), k), "spike_extreme", "spike_ordinary")


_POISSON = " + ".join(f"CASE WHEN u >= {x!r} THEN 1 ELSE 0 END" for x in S.POISSON)


@query(
    "bootstrap_diff",
    f"""WITH {RETURNS}, d AS (SELECT trade_date, avg(r) FILTER (symbol % 2 = 0) - avg(r) FILTER (symbol % 2 = 1) AS d FROM returns GROUP BY 1), o AS (SELECT avg(d) AS diff, count(d) AS n FROM d),
    b AS (SELECT p, d, ('0x' || substr(md5(concat_ws('|', 7, (p - 1) // 4, trade_date)), (p - 1) % 4 * 8 + 1, 8))::BIGINT / 4294967296.0 AS u FROM d, range(1, 201) q(p) WHERE d IS NOT NULL),
    m AS (SELECT p, sum(w * d) / nullif(sum(w), 0) AS m FROM (SELECT p, d, {_POISSON} AS w FROM b) GROUP BY 1)
    SELECT round(any_value(diff), 6) AS diff, any_value(n) AS n, round(least(1.0, 2 * (least(count(*) FILTER (m <= 0), count(*) FILTER (m >= 0)) + 1) / 201), 9) AS p_value FROM m, o""",
)
def _(spark, sf):
    d = returns(spark, sf).groupBy("trade_date").agg(F.avg(F.when(F.col("symbol") % 2 == 0, F.col("r"))).alias("a"), F.avg(F.when(F.col("symbol") % 2 == 1, F.col("r"))).alias("b"))
    return _r(_r(S.bootstrap_diff(d, "a", "b", 200), "diff"), "p_value", n=9)


@query(
    "rank_with_ties",
    """WITH RECURSIVE g AS (SELECT event_type AS name, avg(value) AS mean, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY mean DESC, name) AS k FROM g),
    w AS (SELECT k, name, 1 AS rank, low AS head FROM o WHERE k = 1 UNION ALL SELECT o.k, o.name, CAST(CASE WHEN o.high >= w.head THEN w.rank ELSE o.k END AS INT), CASE WHEN o.high >= w.head THEN w.head ELSE o.low END FROM w JOIN o ON o.k = w.k + 1)
    SELECT name, rank, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM w JOIN o USING (k, name)""",
)
def _(spark, sf):
    return S.rank_with_ties(t(spark, sf, "events").select(F.col("event_type").alias("name"), "value")).select("name", "rank", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


#: Pairs of each flag's own trial: its rows are treated, and all others may be controls, treated otherwise or not.
_SOLO = """tf AS (SELECT 'even' AS flag, * FROM tr WHERE symbol % 2 = 0 UNION ALL SELECT 'low', * FROM tr WHERE close < 50), pf AS (SELECT f.flag, pan.* FROM pan, (VALUES ('even'), ('low')) f(flag) WHERE NOT EXISTS (SELECT 1 FROM tf WHERE tf.flag = f.flag AND tf.symbol = pan.symbol AND tf.trade_date = pan.trade_date)),
pr AS (SELECT t.flag, t.r - c.r AS diff, concat_ws('|', t.symbol, c.symbol, t.trade_date) AS k FROM tf t JOIN pf c ON t.flag = c.flag AND t.trade_date = c.trade_date AND t.sector = c.sector AND abs(t.ln_size - c.ln_size) <= 0.5 AND abs(t.close - c.close) <= 15.0
    QUALIFY row_number() OVER (PARTITION BY t.flag, t.trade_date, t.sector, t.symbol ORDER BY abs(t.ln_size - c.ln_size) / 0.5 + abs(t.close - c.close) / 15.0, c.symbol) <= 2)"""


@query(
    "multi_att",
    f"""WITH {MATCH}, {_SOLO}, {flips("pr", "flag", 50)}, z AS (SELECT t_r - c_r AS y, CASE WHEN t_symbol % 2 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN tr.close < 50 THEN 1 ELSE 0 END AS b, concat_ws('|', t_symbol, c_symbol, m.trade_date) AS k FROM matched m JOIN tr ON tr.symbol = t_symbol AND tr.trade_date = m.trade_date),
    s AS (SELECT count(*) AS n, sum(a) AS aa, sum(b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_ FROM z WHERE y IS NOT NULL),
    x AS (SELECT p, a, b, CASE WHEN substr(md5(concat_ws('|', 7, (p - 1) // 32, k)), (p - 1) % 32 + 1, 1) < '8' THEN y ELSE -y END AS y FROM z, range(1, 51) q(p) WHERE y IS NOT NULL), e AS (SELECT p, sum(a * y) AS ay, sum(b * y) AS by_ FROM x GROUP BY 1),
    o AS (SELECT 'even' AS flag, n, CAST(aa AS BIGINT) AS n_treated, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS att FROM s UNION ALL SELECT 'low', n, CAST(bb AS BIGINT), (aa * by_ - ab * ay) / (aa * bb - ab * ab) FROM s),
    d AS (SELECT 'even' AS flag, (bb * e.ay - ab * e.by_) / (aa * bb - ab * ab) AS e FROM s, e UNION ALL SELECT 'low', (aa * e.by_ - ab * e.ay) / (aa * bb - ab * ab) FROM s, e),
    w AS (SELECT flag, round(any_value(o.att), 6) AS att, round((count(*) FILTER (abs(e) >= abs(o.att) - 1e-12) + 1) / 51, 9) AS p_value, any_value(n) AS n, any_value(n_treated) AS n_treated FROM o JOIN d USING (flag) GROUP BY 1)
    SELECT flag, w.att, w.p_value, n, n_treated, flipped.att AS solo_att, flipped.p_value AS solo_p, coalesce(n_pairs, 0) AS solo_n FROM w LEFT JOIN flipped USING (flag)""",
)
def _(spark, sf):
    conditions = {"even": F.col("symbol") % 2 == 0, "low": F.col("close") < 50}
    diff = (F.col("t_r") - F.col("c_r")).alias("diff")
    key = ["t_symbol", "c_symbol", "trade_date"]
    p = written(panel(spark, sf))
    hit = written(p.join(treated_days(spark, sf), ["symbol", "trade_date"], "left_semi"))
    m = matched(spark, sf, hit, p).select(*key, diff, (F.col("t_symbol") % 2 == 0).cast("int").alias("even"), (F.col("t_close") < 50).cast("int").alias("low"))
    solo = {f: written(matched(spark, sf, hit.where(c), p).select(*key, diff)) for f, c in conditions.items()}
    out = S.multi_att(written(m), ["even", "low"], "diff", key, 50, solo=solo)
    return _r(_r(out, "att", "solo_att"), "p_value", "solo_p", n=9)


@query(
    "moderator_panel",
    f"""WITH {MATCH}, v AS (SELECT t_symbol, c_symbol, m.trade_date, tr.close AS t_close, tr.ln_size AS t_ln_size FROM matched m JOIN tr ON tr.symbol = t_symbol AND tr.trade_date = m.trade_date)
    SELECT t_symbol, c_symbol, trade_date, t_close, t_ln_size, round((rank() OVER (ORDER BY t_close) - 1) / (count(*) OVER () - 1), 6) AS t_close_pct, round((rank() OVER (ORDER BY t_ln_size) - 1) / (count(*) OVER () - 1), 6) AS t_ln_size_pct FROM v""",
)
def _(spark, sf):
    m = matched(spark, sf).select("t_symbol", "c_symbol", "trade_date", "t_close", "t_ln_size").withColumn("rare", F.when(F.col("t_symbol") % 3 == 0, 1.0))
    return S.moderator_panel(m, ["t_close", "t_ln_size", "rare"])[0].withColumns({c: F.round(c, 6) for c in ("t_close_pct", "t_ln_size_pct")}).drop("rare")


@query("local_level_em")
def _(spark, sf):
    from .bindings import bars

    b = bars(spark, sf).withColumn("trade_date", F.trunc("trade_date", "month"))
    return S.local_level_em(b).withColumns({c: F.round(c, 6) for c in ("q", "h")})


@query(
    "kalman_beta",
    f"""WITH RECURSIVE {RETURNS}, o AS (SELECT symbol, trade_date, r AS y, market_mean AS x, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS k FROM returns JOIN market USING (trade_date) WHERE r IS NOT NULL),
    f AS (SELECT symbol, trade_date, k, x, 1.01 * x / (1.01 * x * x + 0.1) * y AS b, 1.01 * 0.1 / (1.01 * x * x + 0.1) AS p FROM o WHERE k = 1
        UNION ALL SELECT o.symbol, o.trade_date, o.k, o.x, f.b + (f.p + 0.01) * o.x / ((f.p + 0.01) * o.x * o.x + 0.1) * (o.y - f.b * o.x), (f.p + 0.01) * 0.1 / ((f.p + 0.01) * o.x * o.x + 0.1) FROM f JOIN o ON o.symbol = f.symbol AND o.k = f.k + 1)
    SELECT symbol, trade_date, round(b, 6) AS beta, round(b * x, 6) AS contribution FROM f""",
)
def _(spark, sf):
    r = P.daily_returns(prices(spark, sf))
    m = P.cross_section_mean(r, min_n=1).select("trade_date", F.col("market_mean").alias("x"))
    return _r(K.kalman_beta(r.join(m, "trade_date").withColumnRenamed("r", "y"), 0.01, 0.1), "beta", "contribution")


def _session_returns(spark, sf):
    """Daily log returns of symbols, of the market and of symbols' sectors, in sessions of a week."""
    r = P.daily_returns(prices(spark, sf)).withColumn("lr", F.log(F.col("r") + 1)).join(sectors(spark, sf).select("symbol", "sector"), "symbol").where("lr IS NOT NULL")
    m = r.groupBy("trade_date").agg(F.avg("lr").alias("market"))
    s = r.groupBy("trade_date", "sector").agg(F.avg("lr").alias("s"))
    return r.join(m, "trade_date").join(s, ["trade_date", "sector"]).select("symbol", F.to_date(F.date_trunc("week", "trade_date")).alias("session"), "trade_date", F.col("lr").alias("y"), "market", F.col("s").alias("sector"))


# Variances of level and noise of log closes, by 20 rounds of EM: a filter forwards (first level: the first close, variance h), a smoother backwards, and the moments.
_GAIN = "(a.p + q) / (a.p + q + h)"
_BACK = "x.p / a.f"
_EM = f"""y0 AS (SELECT symbol, CAST(date_trunc('week', trade_date) AS DATE) AS session, list(ln(close) ORDER BY trade_date) AS y FROM prices WHERE close > 0 GROUP BY 1, 2 HAVING count(*) > 2),
    em AS (SELECT symbol, session, y, 0 AS k, greatest(list_var_pop(list_transform(range(2, len(y) + 1), lambda i: y[i] - y[i - 1])) / 2, 1e-10) AS q, greatest(list_var_pop(list_transform(range(2, len(y) + 1), lambda i: y[i] - y[i - 1])) / 2, 1e-10) AS h FROM y0
        UNION ALL SELECT symbol, session, y, k + 1, greatest(list_avg(list_transform(range(2, len(y) + 1), lambda i: (s[i].s - s[i - 1].s) ** 2 + s[i].v + s[i - 1].v - 2 * s[i - 1].c)), 1e-12), greatest(list_avg(list_transform(s, lambda e: (e.y - e.s) ** 2 + e.v)), 1e-12)
        FROM (SELECT *, list_reverse(list_reduce(list_transform(list_reverse(f), lambda e: {{'f': e.f, 'p': e.p, 's': e.a, 'v': e.p, 'y': e.y, 'l': [{{'s': e.a, 'v': e.p, 'c': CAST(0 AS DOUBLE), 'y': e.y}}]}}),
            lambda a, x: {{'f': x.f, 'p': x.p, 's': x.s + {_BACK} * (a.s - x.s), 'v': x.p + {_BACK} * {_BACK} * (a.v - a.f), 'y': x.y, 'l': list_append(a.l, {{'s': x.s + {_BACK} * (a.s - x.s), 'v': x.p + {_BACK} * {_BACK} * (a.v - a.f), 'c': {_BACK} * a.v, 'y': x.y}})}}).l) AS s
        FROM (SELECT *, list_reduce(list_transform(y, lambda e: {{'y': e, 'a': e, 'p': h / 2, 'l': [{{'y': e, 'a': e, 'p': h / 2, 'f': h}}]}}),
            lambda a, x: {{'y': x.y, 'a': a.a + {_GAIN} * (x.y - a.a), 'p': (1 - {_GAIN}) * (a.p + q), 'l': list_append(a.l, {{'y': x.y, 'a': a.a + {_GAIN} * (x.y - a.a), 'p': (1 - {_GAIN}) * (a.p + q), 'f': a.p + q}})}}).l AS f
        FROM em WHERE k < 20))),
    v AS (SELECT symbol, session, q, h FROM em WHERE k = 20)"""


@query(
    "kalman_beta_sector",
    f"""WITH RECURSIVE {RETURNS}, {SECTORS}, l AS (SELECT symbol, sector, trade_date, ln(CASE WHEN r > -1 THEN r + 1 END) AS y FROM returns JOIN sectors USING (symbol) WHERE r > -1),
    z AS (SELECT symbol, CAST(date_trunc('week', trade_date) AS DATE) AS session, trade_date, y, avg(y) OVER (PARTITION BY trade_date) AS m, avg(y) OVER (PARTITION BY trade_date, sector) AS s FROM l),
    g AS (SELECT symbol, session, count(*) AS n, var_samp(m) AS vm, sum(y * y) AS yy, sum(m * m) AS mm, sum(s * s) AS ss, sum(y * m) AS ym, sum(y * s) AS ys, sum(m * s) AS ms FROM z GROUP BY 1, 2),
    p0 AS (SELECT *, ms / mm AS gamma, ss - ms / mm * ms AS oo FROM g), p1 AS (SELECT *, ym / mm AS bm, (ys - gamma * ym) / oo AS bs FROM p0 WHERE oo > 1e-12 * ss),
    {_EM},
    p2 AS (SELECT symbol, session, gamma, bm, bs, n, vm, greatest(yy - bm * bm * mm - bs * bs * oo, 0) / greatest(n - 2, 1) AS e, mm, oo, greatest(q - bm * bm * vm, 0.1 * q) + 2 * v.h AS h FROM p1 JOIN v USING (symbol, session) WHERE n >= 4),
    nx AS (SELECT symbol, session, lead(session) OVER (PARTITION BY symbol ORDER BY session) AS nxt FROM g),
    pr AS (SELECT p2.symbol, nxt AS session, gamma, bm, bs, e / mm AS pm, e / oo AS ps, h / (vm * n * n) AS q, h FROM p2 JOIN nx USING (symbol, session) WHERE nxt IS NOT NULL),
    x AS (SELECT z.symbol, z.session, trade_date, y, m, s - gamma * m AS o, bm, bs, pm, ps, q, h, row_number() OVER (PARTITION BY z.symbol, z.session ORDER BY trade_date) AS k FROM z JOIN pr ON z.symbol = pr.symbol AND z.session = pr.session),
    f AS (SELECT symbol, session, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS o, bm AS a, bs AS b, pm AS p, CAST(0 AS DOUBLE) AS c, ps AS r FROM x WHERE k = 1
        UNION ALL SELECT symbol, session, k, m, o, a + (p * m + c * o) / t * (y - a * m - b * o), b + (c * m + r * o) / t * (y - a * m - b * o), p - (p * m + c * o) * (p * m + c * o) / t, c - (p * m + c * o) * (c * m + r * o) / t, r - (c * m + r * o) * (c * m + r * o) / t
        FROM (SELECT *, m * (p * m + c * o) + o * (c * m + r * o) + h AS t FROM (SELECT x.symbol, x.session, x.k, x.m, x.o, x.y, x.h, f.a, f.b, f.p + x.q AS p, f.c, f.r + x.q AS r FROM f JOIN x ON x.symbol = f.symbol AND x.session = f.session AND x.k = f.k + 1)))
    SELECT symbol, session, count(*) AS n, round(sum(a * m), 5) AS market_contribution, round(1.96 * sqrt(sum(p * m * m)), 5) AS market_ci, round(sum(b * o), 5) AS sector_contribution, round(1.96 * sqrt(sum(r * o * o)), 5) AS sector_ci FROM f WHERE k > 0 GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _(spark, sf):
    rows = written(_session_returns(spark, sf))
    closes = prices(spark, sf).withColumn("session", F.to_date(F.date_trunc("week", "trade_date")))
    variances = S.local_level_em(closes, day="session", ts="trade_date")
    paths = K.two_factor_beta(rows, written(K.session_priors(rows, variances, 4)), order="trade_date")
    names = ["market_contribution", "market_ci", "sector_contribution", "sector_ci"]
    return _r(K.path_contributions(paths).select("symbol", "session", "n", *names), *names, n=5)


@query("correlation_clusters")
def _(spark, sf):
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("symbol"), F.posexplode("embedding").alias("trade_date", "r"))
    return T.correlation_clusters(S.spanning_correlations(v, 10), 4, 3)


@query("spectrum_noise")
def _(spark, sf):
    return N.spectrum_noise(t(spark, sf, "embeddings"), 5, "embedding").withColumn("eigenvalue", F.round("eigenvalue", 4))


@query(
    "spectrum_shrinkage",
    """WITH r AS (SELECT row_number() OVER () AS i, embedding FROM embeddings WHERE embedding IS NOT NULL), x AS (SELECT i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS j FROM r),
    s AS (SELECT i, j, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM x WINDOW w AS (PARTITION BY j)),
    k AS (SELECT count(DISTINCT i) AS n, count(DISTINCT j) AS p, sum(z * z) AS t FROM s), c AS (SELECT a.j AS a, b.j AS b, sum(a.z * b.z) AS c FROM s a JOIN s b USING (i) GROUP BY 1, 2),
    g AS (SELECT sum(c * c) AS s, sum(c * c) FILTER (a = b) AS d FROM c), f AS (SELECT sum(q * q) AS f FROM (SELECT sum(z * z) AS q FROM s GROUP BY i)),
    o AS (SELECT n, p, least((f / n - s / n / n) / n, s / n / n - t * t / n / n / p) / (s / n / n - t * t / n / n / p) AS share, (s - d) / n / n / (p * (p - 1)) AS raw FROM k, g, f)
    SELECT n, p, round(share, 6) AS shrinkage, round(raw, 8) AS raw, round(raw * (1 - share) * (1 - share), 8) AS shrunk FROM o""",
)
def _(spark, sf):
    return _r(_r(N.shrinkage(t(spark, sf, "embeddings"), "embedding"), "shrinkage"), "raw", "shrunk", n=8)
