"""Events and links: orders as events of suppliers, parts and customers; user events with types; documents with dictionaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.operators import events as V
from marketlens.operators import mentions as N
from marketlens.registry import query

from .bindings import RETURNS, SECTORS, returns, sectors, t

# arguments of orders: one supplier, part and customer for each line
_ARGS = """args AS (SELECT l_orderkey AS event_id, 'supplier' AS role, l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS link_date FROM lineitem
UNION ALL SELECT l_orderkey, 'part', 100000 + l_partkey % 50, CAST(l_shipdate AS DATE) FROM lineitem)"""
_EDGES = f"""{_ARGS}, edges AS (SELECT DISTINCT a.entity_id AS src, b.entity_id AS dst, 'SUPPLY_CHAIN' AS link_type, a.link_date FROM args a JOIN args b USING (event_id) WHERE a.role = 'supplier' AND b.role = 'part'
UNION SELECT DISTINCT a.entity_id, b.entity_id, 'PARTNERSHIP', a.link_date FROM args a JOIN args b USING (event_id) WHERE a.role = 'supplier' AND b.role = 'supplier' AND a.entity_id <> b.entity_id)"""


def _args(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.to_date("l_shipdate").alias("link_date"), "l_suppkey", (F.lit(100000) + F.col("l_partkey") % 50).alias("part"))
    return li.select("event_id", F.lit("supplier").alias("role"), F.col("l_suppkey").alias("entity_id"), "link_date").unionByName(li.select("event_id", F.lit("part").alias("role"), F.col("part").alias("entity_id"), "link_date"))


def _edges(spark, sf, **how):
    return V.link_edges(_args(spark, sf), [("supplier", "part", "SUPPLY_CHAIN"), ("supplier", "supplier", "PARTNERSHIP")], **how)


@query("link_edges", f"WITH {_EDGES} SELECT * FROM edges")
def _(spark, sf):
    return _edges(spark, sf)


@query("union_distinct_pairs", f"WITH {_EDGES} SELECT src, dst, link_type, link_date FROM edges UNION SELECT dst, src, link_type, link_date FROM edges")
def _(spark, sf):
    return V.union_distinct_pairs(_edges(spark, sf, distinct=False))


_PAIRS = "pairs AS (SELECT DISTINCT s_suppkey AS x, o_orderkey % 97 AS y, CAST(o_orderdate AS DATE) AS d FROM supplier JOIN orders ON o_orderkey % 97 = (s_suppkey + 1) % 97)"


def _pairs(spark, sf):
    # Days are made distinct before they meet suppliers: the join's rows are the pairs.
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("x")).distinct()
    o = t(spark, sf, "orders").select((F.col("o_orderkey") % 97).alias("y"), F.to_date("o_orderdate").alias("d")).distinct()
    return s.join(o, F.col("y") == (F.col("x") + 1) % 97)


@query("link_indicator", f"WITH {_EDGES}, {_PAIRS} SELECT x, y, d, EXISTS (SELECT 1 FROM edges WHERE link_type = 'PARTNERSHIP' AND link_date <= d AND ((src = x AND dst = y) OR (src = y AND dst = x))) AS linked FROM pairs")
def _(spark, sf):
    links = V.link_edges(_args(spark, sf), [("supplier", "supplier", "PARTNERSHIP")], first=True)
    return V.link_indicator(_pairs(spark, sf), links, "PARTNERSHIP")


@query("same_attribute_flag", f"WITH {_PAIRS} SELECT x, y, d, coalesce(a.s_nationkey = b.s_nationkey, false) AS same FROM pairs LEFT JOIN supplier a ON a.s_suppkey = x LEFT JOIN supplier b ON b.s_suppkey = y")
def _(spark, sf):
    return V.same_attribute_flag(_pairs(spark, sf), t(spark, sf, "supplier"), "s_nationkey", key="s_suppkey")


_TREATED = "tre AS (SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS d, l_returnflag AS event_type FROM lineitem)"


def _treated(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("d"), F.col("l_returnflag").alias("event_type"))


@query(
    "spillover_treated",
    f"""WITH {_EDGES}, {_TREATED}, hit AS (SELECT DISTINCT entity_id, d FROM tre WHERE event_type = 'R'), both_ AS (SELECT src, dst, link_date FROM edges WHERE link_type = 'PARTNERSHIP' UNION SELECT dst, src, link_date FROM edges WHERE link_type = 'PARTNERSHIP')
    SELECT DISTINCT dst AS entity_id, d FROM hit JOIN both_ ON src = entity_id WHERE link_date <= d AND (dst, d) NOT IN (SELECT (entity_id, d) FROM hit)""",
)
def _(spark, sf):
    links = V.link_edges(_args(spark, sf), [("supplier", "supplier", "PARTNERSHIP")], undirected=True)
    return V.spillover_treated(_treated(spark, sf), links, "R", "PARTNERSHIP")


@query("typed_hop", f"WITH {_EDGES} SELECT DISTINCT dst AS entity_id FROM edges WHERE link_type = 'SUPPLY_CHAIN' AND src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)")
def _(spark, sf):
    return V.typed_hop(t(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("entity_id")), _edges(spark, sf), "SUPPLY_CHAIN")


@query("link_counts", f"WITH {_EDGES}, n AS (SELECT src, link_type, count(DISTINCT dst) AS n FROM edges GROUP BY 1, 2) SELECT src, link_type, n, CAST(row_number() OVER (PARTITION BY src ORDER BY n DESC, link_type) AS INT) AS rank FROM n QUALIFY rank <= 1")
def _(spark, sf):
    return V.link_counts(_edges(spark, sf, first=True), 1)


_MACRO = "mac AS (SELECT CAST(ts AS DATE) AS trade_date, count(*) AS macro FROM events WHERE event_type = 'error' GROUP BY 1)"


@query("join_date_broadcast", f"WITH {RETURNS}, {_MACRO} SELECT symbol, trade_date, macro FROM returns LEFT JOIN mac USING (trade_date)")
def _(spark, sf):
    m = t(spark, sf, "events").where("event_type = 'error'").groupBy(F.to_date("ts").alias("trade_date")).agg(F.count("*").alias("macro"))
    return V.join_date_broadcast(returns(spark, sf), m).select("symbol", "trade_date", "macro")


_EV = "ev AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS trade_date FROM events WHERE event_type = 'purchase' AND value > 60)"


def treated_days(spark, sf):
    return t(spark, sf, "events").where("event_type = 'purchase' AND value > 60").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date")).distinct()


@query("control_pool", f"WITH {RETURNS}, {_EV} SELECT symbol, trade_date, r IS NULL AS is_first FROM returns r WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.symbol = r.symbol AND ev.trade_date = r.trade_date)")
def _(spark, sf):
    return V.control_pool(returns(spark, sf), treated_days(spark, sf), ["symbol", "trade_date"]).select("symbol", "trade_date", F.col("r").isNull().alias("is_first"))


CALIPERS = {"ln_size": 0.5, "close": 15.0}
MATCH = f"""{RETURNS}, {SECTORS}, {_EV}, pan AS (SELECT symbol, trade_date, close, r, ar, sector, ln_size FROM abnormal JOIN sectors USING (symbol)),
tr AS (SELECT pan.* FROM pan JOIN ev USING (symbol, trade_date)), po AS (SELECT pan.* FROM pan ANTI JOIN ev USING (symbol, trade_date)),
cand AS (SELECT t.trade_date, t.sector, t.symbol AS t_symbol, c.symbol AS c_symbol, t.r AS t_r, c.r AS c_r, abs(t.ln_size - c.ln_size) / 0.5 + abs(t.close - c.close) / 15.0 AS distance FROM tr t JOIN po c ON t.trade_date = c.trade_date AND t.sector = c.sector AND abs(t.ln_size - c.ln_size) <= 0.5 AND abs(t.close - c.close) <= 15.0),
matched AS (SELECT *, CAST(row_number() OVER (PARTITION BY trade_date, sector, t_symbol ORDER BY distance, c_symbol) AS INT) AS rank FROM cand QUALIFY rank <= 2)"""


def panel(spark, sf):
    return returns(spark, sf).join(sectors(spark, sf), "symbol").select("symbol", "trade_date", "close", "r", "ar", "sector", "ln_size")


def matched(spark, sf, hit=None, p=None):
    """Pairs of treated rows (symbol, trade_date of hit; treated_days() without) and their controls, which are not. p: panel(), where it is there already."""
    p, hit = panel(spark, sf) if p is None else p, treated_days(spark, sf) if hit is None else hit
    treated, pool = p.join(hit, ["symbol", "trade_date"], "left_semi"), V.control_pool(p, hit, ["symbol", "trade_date"])
    m = V.caliper_match(treated, pool, ["trade_date", "sector"], CALIPERS, 2)
    rs = p.select("symbol", "trade_date", "r")
    m = m.join(rs.select(F.col("symbol").alias("t_symbol"), "trade_date", F.col("r").alias("t_r")), ["t_symbol", "trade_date"])
    return m.join(rs.select(F.col("symbol").alias("c_symbol"), "trade_date", F.col("r").alias("c_r")), ["c_symbol", "trade_date"])


@query("caliper_match", f"WITH {MATCH} SELECT trade_date, sector, t_symbol, c_symbol, rank, round(distance, 9) AS distance FROM matched")
def _(spark, sf):
    return matched(spark, sf).select("trade_date", "sector", "t_symbol", "c_symbol", "rank", F.round("distance", 9).alias("distance"))


@query("multi_treatment_flags", "SELECT user_id, CAST(ts AS DATE) AS d, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS is_purchase, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS is_error FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2")
def _(spark, sf):
    return V.multi_treatment_flags(t(spark, sf, "events").withColumn("d", F.to_date("ts")), ["purchase", "error"], ["user_id", "d"])


@query(
    "relation_panel",
    f"""WITH {RETURNS}, e AS (SELECT DISTINCT user_id AS x, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error' AND value > 250), lk AS (SELECT a.symbol AS src, a.symbol + 1 AS dst, min(trade_date) + 10 AS link_date FROM returns a GROUP BY 1, 2)
    SELECT x, symbol AS y, d, EXISTS (SELECT 1 FROM lk WHERE link_date <= d AND ((src = x AND dst = symbol) OR (src = symbol AND dst = x))) AS linked FROM e JOIN returns ON trade_date = d WHERE x <> symbol""",
)
def _(spark, sf):
    p = returns(spark, sf).select("symbol", "trade_date")
    edges = p.groupBy(F.col("symbol").alias("src"), (F.col("symbol") + 1).alias("dst")).agg(F.date_add(F.min("trade_date"), 10).alias("link_date"))
    large = t(spark, sf, "events").where("event_type = 'error' AND value > 250").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"))
    return V.relation_panel(p, large, edges).select("x", "y", "d", "linked")


@query("lineage_exists", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7))) AS used FROM customer")
def _(spark, sf):
    hops = [(t(spark, sf, "orders"), "o_custkey", "o_orderkey"), (t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_partkey"), (t(spark, sf, "part").where("p_size = 7").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "p_size")]
    docs = t(spark, sf, "customer").select("c_custkey")
    return V.lineage_exists(docs, hops, "c_custkey")


@query(
    "event_times",
    "WITH s AS (SELECT l_orderkey AS event_id, l_shipdate AS ts FROM lineitem WHERE l_partkey % 7 = 0) SELECT o_orderkey AS event_id, coalesce(min(s.ts), any_value(o_orderdate)) AS event_time, min(s.ts) IS NOT NULL AS promoted FROM orders LEFT JOIN s ON o_orderkey = event_id GROUP BY 1",
)
def _(spark, sf):
    ev = t(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("available_at"))
    li = t(spark, sf, "lineitem").withColumn("doc_id", F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 7)
    side = li.where("l_partkey % 7 = 0").groupBy("doc_id").agg(F.min("l_shipdate").alias("ts"))
    return V.event_times(ev, li.select(F.col("l_orderkey").alias("event_id"), "doc_id"), side).select("event_id", "event_time", "promoted")


@query("event_arguments_list", f"WITH {_ARGS} SELECT event_id, array_to_string(list_sort(list(role || '=' || entity_id)), ';') AS arguments FROM args GROUP BY 1")
def _(spark, sf):
    return V.event_arguments_list(_args(spark, sf), name="entity_id").withColumn("arguments", F.array_join("arguments", ";"))


@query(
    "event_contexts",
    f"""WITH {_ARGS}, e AS (SELECT DISTINCT event_id FROM args), hit AS (SELECT DISTINCT event_id FROM args WHERE entity_id < 5), li AS (SELECT event_id, array_to_string(list_sort(list(role || '=' || entity_id)), ';') AS arguments FROM args GROUP BY 1)
    SELECT event_id, o_orderpriority AS title, arguments FROM e JOIN hit USING (event_id) LEFT JOIN orders ON o_orderkey = event_id LEFT JOIN li USING (event_id)""",
)
def _(spark, sf):
    a = _args(spark, sf)
    titles = t(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("published"))
    return V.event_contexts(a.select("event_id").distinct(), a, titles, spark.range(5).select(F.col("id").alias("entity_id")))


STAGES = {"view": 1, "click": 2, "signup": 3, "purchase": 4}
_NOV = """x AS (SELECT event_id, user_id, CASE WHEN event_id % 11 > 0 THEN CAST(floor(value) AS BIGINT) % 5 END AS topic, event_type, event_id % 13 = 0 AS is_correction, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS k FROM events),
nov AS (SELECT *, CASE WHEN topic IS NULL THEN 'UNKNOWN' WHEN row_number() OVER w = 1 THEN 'FIRST' WHEN is_correction THEN 'CORRECTION' WHEN k > max(k) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'FOLLOW_UP_STAGE' ELSE 'DUPLICATE_REBROADCAST' END AS novelty FROM x WINDOW w AS (PARTITION BY user_id, topic ORDER BY ts, event_id))"""


def topics(spark, sf):
    return t(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 11 > 0, F.floor("value") % 5).alias("topic"), F.col("event_type").alias("stage"), (F.col("event_id") % 13 == 0).alias("is_correction"), "ts")


def novel(spark, sf):
    return V.novelty(topics(spark, sf), ["user_id", "topic"], STAGES)


@query("novelty", f"WITH {_NOV} SELECT event_id, novelty FROM nov")
def _(spark, sf):
    return novel(spark, sf).select("event_id", "novelty")


@query("thread_state_counts", f"WITH {_NOV} SELECT event_type AS stage, novelty, count(*) AS n FROM nov GROUP BY 1, 2")
def _(spark, sf):
    return V.thread_state_counts(novel(spark, sf), ["stage", "novelty"])


_TH = "e AS (SELECT event_id, user_id * 10 + CAST(floor(value) AS BIGINT) % 5 AS thread_id, ts, user_id AS entity_id FROM events)"


def _threads(spark, sf):
    return t(spark, sf, "events").select("event_id", (F.col("user_id") * 10 + F.floor("value") % 5).alias("thread_id"), "ts", F.col("user_id").alias("entity_id"), F.lit("FIRST").alias("novelty"))


@query("thread_history", f"WITH {_TH} SELECT event_id, thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY ts DESC, event_id DESC) AS INT) AS nth FROM e WHERE event_id % 500 <> 0 AND thread_id IN (SELECT thread_id FROM e WHERE event_id % 500 = 0) QUALIFY nth <= 5")
def _(spark, sf):
    e = _threads(spark, sf)
    return V.thread_history(e, e.where("event_id % 500 = 0").select("event_id")).select("event_id", "thread_id", "nth")


@query(
    "event_object_set",
    f"""WITH {_TH}, o AS (SELECT * FROM e WHERE CAST(ts AS DATE) > DATE '2024-01-05' AND CAST(ts AS DATE) <= DATE '2024-01-20'), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY entity_id, thread_id ORDER BY ts, event_id) = 1)
    SELECT entity_id, event_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS INT) AS nth FROM f QUALIFY nth <= 3""",
)
def _(spark, sf):
    return V.event_object_set(_threads(spark, sf), dt.date(2024, 1, 5), dt.date(2024, 1, 20), 3).select("entity_id", "event_id", "nth")


@query(
    "member_news",
    f"""WITH c AS (SELECT c_nationkey AS fund, c_custkey AS constituent, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3),
    n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events QUALIFY nth <= 2) SELECT fund, constituent, CAST(rank AS INT) AS rank, event_id, CAST(nth AS INT) AS nth FROM c JOIN n ON user_id = constituent""",
)
def _(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("fund"), F.col("c_custkey").alias("constituent"), F.col("c_acctbal").alias("contribution"))
    return V.member_news(c, _threads(spark, sf).select("entity_id", "event_id", "ts"), 3, 2).select("fund", "constituent", "rank", "event_id", "nth")


_DEL = "del AS (SELECT o_orderkey AS result_id, r_regionkey AS tenant_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY o_orderkey) AS cursor FROM orders, region WHERE o_orderkey % 5 = r_regionkey AND o_orderkey % 2 = 0)"


def _deliveries(spark, sf):
    from pyspark.sql import Window

    o = t(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("result_id"), (F.col("o_orderkey") % 5).cast("int").alias("tenant_id"))
    return o.withColumn("cursor", F.row_number().over(Window.partitionBy("tenant_id").orderBy("result_id")))


@query(
    "fanout_deliveries",
    f"""WITH {_DEL}, n AS (SELECT o_orderkey AS result_id FROM orders WHERE o_orderkey % 50 < 4 AND o_orderkey NOT IN (SELECT result_id FROM del)), l AS (SELECT tenant_id, max(cursor) AS last FROM del GROUP BY 1)
    SELECT result_id, r_regionkey AS tenant_id, coalesce(last, 0) + row_number() OVER (PARTITION BY r_regionkey ORDER BY result_id) AS cursor FROM n, region LEFT JOIN l ON tenant_id = r_regionkey""",
)
def _(spark, sf):
    res = t(spark, sf, "orders").where("o_orderkey % 50 < 4").select(F.col("o_orderkey").alias("result_id"))
    return V.fanout_deliveries(res, t(spark, sf, "region").select(F.col("r_regionkey").alias("tenant_id")), _deliveries(spark, sf)).select("result_id", "tenant_id", F.col("cursor").cast("long").alias("cursor"))


@query(
    "invalidate_deliveries",
    f"""WITH {_DEL}, s AS (SELECT DISTINCT result_id, tenant_id FROM del WHERE result_id % 100 = 6), l AS (SELECT tenant_id, max(cursor) AS last FROM del GROUP BY 1) SELECT result_id, tenant_id, last + row_number() OVER (PARTITION BY tenant_id ORDER BY result_id) AS cursor FROM s JOIN l USING (tenant_id)""",
)
def _(spark, sf):
    w = t(spark, sf, "orders").where("o_orderkey % 100 = 6").select(F.col("o_orderkey").alias("result_id"))
    return V.invalidate_deliveries(w, _deliveries(spark, sf)).withColumn("cursor", F.col("cursor").cast("long"))


@query(
    "null_safe_lookup",
    """WITH l AS (SELECT event_id, nullif(event_type, 'error') AS a, nullif(user_id % 4, 0) AS b FROM events), r AS (SELECT nullif(event_type, 'error') AS a, nullif(user_id % 4, 0) AS b, arg_max(event_id, ts) AS run FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
    SELECT event_id, run FROM l LEFT JOIN r ON l.a IS NOT DISTINCT FROM r.a AND l.b IS NOT DISTINCT FROM r.b""",
)
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("a", F.nullif("event_type", F.lit("error"))).withColumn("b", F.nullif(F.col("user_id") % 4, F.lit(0)))
    right = e.where("event_id % 3 = 0").select("a", "b", "ts", F.col("event_id").alias("run"))
    return V.null_safe_lookup(e.select("event_id", "a", "b"), right, ["a", "b"], ["ts"], ["run"]).select("event_id", "run")


@query(
    "tolerance_match",
    """WITH m AS (SELECT o_orderkey AS measure_id, o_custkey AS issuer, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT o_orderkey AS fact_id, o_custkey AS issuer, o_totalprice * 1.05 AS a, CAST(o_orderdate AS DATE) + 3 AS fd FROM orders WHERE o_orderkey % 3 > 0),
    k AS (SELECT measure_id, count(DISTINCT fact_id) AS n, min(fact_id) AS f FROM m JOIN f USING (issuer) WHERE abs(amount - a) <= 0.08 * abs(a) AND abs(d - fd) <= 7 GROUP BY 1)
    SELECT measure_id, CASE WHEN n IS NULL THEN 'UNMATCHED' WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN f END AS fact_id FROM m LEFT JOIN k USING (measure_id)""",
)
def _(spark, sf):
    o = t(spark, sf, "orders")
    m = o.select(F.col("o_orderkey").alias("measure_id"), F.col("o_custkey").alias("issuer"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("d"))
    f = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("issuer"), (F.col("o_totalprice") * 1.05).alias("amount"), F.date_add(F.to_date("o_orderdate"), 3).alias("d"))
    return V.tolerance_match(m, f, "issuer").select("measure_id", "status", "fact_id")


@query(
    "dictionary_mentions",
    """WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS name, p_partkey AS e FROM part), n AS (SELECT name, min(e) AS e FROM w GROUP BY 1 UNION ALL SELECT lower(n_name), 1000000 + n_nationkey FROM nation UNION ALL SELECT 'zed zed' || user_id, 2000000 + user_id FROM events UNION ALL SELECT 'the', 1 UNION ALL SELECT 'the', 2),
    k AS (SELECT name, min(e) AS e FROM n WHERE length(name) >= 3 GROUP BY 1 HAVING count(DISTINCT e) = 1),
    d AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS x FROM documents UNION ALL SELECT DISTINCT -user_id, 'the zed zed' || user_id || 'rose' FROM events)
    SELECT DISTINCT doc_id, e AS entity_id FROM d JOIN k ON contains(x, name)""",
)
def _(spark, sf):
    words = t(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name"), F.col("p_partkey").alias("entity_id")).groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    users = t(spark, sf, "events").select("user_id").distinct()
    nations = t(spark, sf, "nation").select(F.lower("n_name").alias("name"), (F.lit(1000000) + F.col("n_nationkey")).alias("entity_id"))
    names = words.unionByName(nations).unionByName(users.select(F.concat(F.lit("zed  zed"), F.col("user_id").cast("string")).alias("name"), (F.lit(2000000) + F.col("user_id")).alias("entity_id")))
    names = names.unionByName(spark.createDataFrame([("the", 1), ("the", 2)], "name string, entity_id long"))
    # A wide letter, and white space of other kinds.
    texts = t(spark, sf, "documents").select("doc_id", "text").unionByName(users.select((-F.col("user_id")).alias("doc_id"), F.concat(F.lit("the \t\uff5aed\u3000zed"), F.col("user_id").cast("string"), F.lit("rose")).alias("text")))
    return N.dictionary_mentions(texts, names)


_MEN = "m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') WHEN 1 THEN 'dup' WHEN 2 THEN ' Unknown  co ' ELSE 'customer#000000007' END AS mention, CASE event_id % 3 WHEN 0 THEN 'issuer' WHEN 1 THEN 'country' ELSE 'theme' END AS role FROM events), k AS (SELECT lower(c_name) AS k, c_custkey AS e FROM customer UNION ALL SELECT 'dup', 1 UNION ALL SELECT 'dup', 2)"
_RES = "r AS (SELECT event_id, role, mention, n, e FROM m LEFT JOIN (SELECT k, count(DISTINCT e) AS n, min(e) AS e FROM k GROUP BY 1) ON k = lower(regexp_replace(trim(mention), '\\s+', ' ', 'g')))"


def _mentions(spark, sf):
    k = F.col("event_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).when(k % 4 == 1, "dup").when(k % 4 == 2, " Unknown  co ").otherwise("customer#000000007")
    m = t(spark, sf, "events").select("event_id", name.alias("mention"), F.when(k % 3 == 0, "issuer").when(k % 3 == 1, "country").otherwise("theme").alias("role"))
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    dup = c.where("c_custkey IN (1, 2)".replace("c_custkey", "entity_id")).select("entity_id", F.lit("dup").alias("name"))
    return m, c.union(dup)


@query("resolve_entities", f"WITH {_MEN}, {_RES} SELECT event_id, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN e END AS entity_id FROM r")
def _(spark, sf):
    return V.resolve_entities(*_mentions(spark, sf)).select("event_id", "status", "entity_id")


@query(
    "resolve_by_role",
    f"""WITH {_MEN}, {_RES} SELECT event_id, CASE role WHEN 'country' THEN CASE WHEN mention = 'dup' THEN 'REGISTRY_HIT' ELSE 'REGISTRY_MISS' END WHEN 'theme' THEN 'CONCEPT' ELSE CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END END AS status,
    CASE role WHEN 'country' THEN CASE WHEN mention = 'dup' THEN '99' END WHEN 'theme' THEN 'concept_' || substr(sha256('=' || lower(trim(mention))), 1, 24) ELSE CASE WHEN n = 1 THEN CAST(e AS VARCHAR) END END AS resolved FROM r""",
)
def _(spark, sf):
    m, e = _mentions(spark, sf)
    registry = e.where("name = 'dup'").select("name").distinct().select("name", F.lit(99).alias("registry_id"))
    return V.resolve_by_role(m, registry, e, ["country"], ["theme"]).select("event_id", "status", "resolved")


@query("calendar_spine", "SELECT d, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-01-10', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) USING (d)")
def _(spark, sf):
    n = t(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return V.calendar_spine(n, dt.date(2023, 12, 25), dt.date(2024, 1, 10), "d", ["n"])


@query(
    "boundary_anti",
    """WITH d AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS w FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    SELECT (SELECT count(*) FROM p WHERE o_orderkey NOT IN (SELECT l_orderkey FROM d)) AS undelivered, (SELECT count(*) FROM d WHERE w = 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM p)) AS orphaned""",
)
def _(spark, sf):
    r = t(spark, sf, "orders").select(F.col("o_orderkey").alias("result_id"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("status"))
    d = t(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("result_id"), (F.col("l_returnflag") == "R").alias("withdrawn"))
    return V.boundary_anti(r, d)


@query("missing_expected", "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return V.missing_expected(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), t(spark, sf, "events").select(F.col("user_id").alias("c_custkey")), ["c_custkey"], [(n, "c_nationkey")])


@query("event_type_screen", "SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events WHERE starts_with(event_type, 'p') OR starts_with(event_type, 's') OR starts_with(event_type, 'v') GROUP BY 1 HAVING n_days >= 5 ORDER BY 2 DESC, 1 LIMIT 2")
def _(spark, sf):
    return V.event_type_screen(t(spark, sf, "events"), ["p", "s", "v"], 5, 2, F.to_date("ts"))


@query(
    "event_slot_menu",
    """WITH l AS (SELECT event_type, 'props' AS slot, props AS slot_value FROM events UNION ALL SELECT event_type, 'bucket', CAST(user_id % 7 AS VARCHAR) FROM events), n AS (SELECT event_type, slot, slot_value, count(*) AS n FROM l WHERE slot_value IS NOT NULL GROUP BY ALL HAVING n >= 5)
    SELECT *, CAST(row_number() OVER (PARTITION BY event_type, slot ORDER BY n DESC, slot_value) AS INT) AS rank FROM n QUALIFY rank <= 3""",
)
def _(spark, sf):
    return V.event_slot_menu(t(spark, sf, "events").withColumn("bucket", F.col("user_id") % 7), ["props", "bucket"], 5, 3)


@query("title_duplicates", "SELECT lang, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm_title, count(DISTINCT doc_id) AS n_ids, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1, 2 HAVING n_ids > 1")
def _(spark, sf):
    return V.title_duplicates(t(spark, sf, "documents").withColumn("title", F.col("text")), "lang", "title", "doc_id")


_FUN = "tr AS (SELECT DISTINCT user_id, user_id % 2 AS lane FROM events WHERE event_type = 'view' AND CAST(ts AS DATE) = DATE '2024-01-10'), a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-11'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) <= DATE '2024-01-13')"


@query("cohort_funnel", f"WITH {_FUN} SELECT lane, count(*) AS triggered, count(a.user_id) AS clicked, count(CASE WHEN a.user_id IS NOT NULL THEN b.user_id END) AS bought FROM tr LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("d", F.to_date("ts"))
    tr = e.where("event_type = 'view' AND d = DATE '2024-01-10'").withColumn("lane", F.col("user_id") % 2)
    return V.cohort_funnel(tr, [("clicked", e.where("event_type = 'click' AND d = DATE '2024-01-11'")), ("bought", e.where("event_type = 'purchase' AND d <= DATE '2024-01-13'"))], "user_id", "lane")


@query(
    "trend_funnel",
    """WITH tr AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view'), f AS (SELECT d, count(*) AS triggered, count(*) FILTER (event_id % 2 = 0) AS clicked, count(*) FILTER (event_id % 6 = 0) AS bought FROM tr GROUP BY 1)
    SELECT d, coalesce(triggered, 0) AS triggered, coalesce(clicked, 0) AS clicked, coalesce(bought, 0) AS bought FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN f USING (d)""",
)
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return V.trend_funnel(e.where("event_type = 'view'"), [("clicked", e.where("event_id % 2 = 0")), ("bought", e.where("event_id % 3 = 0"))], "event_id", "d", dt.date(2023, 12, 28), dt.date(2024, 1, 20))
