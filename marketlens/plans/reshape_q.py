"""Filters and reshaping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.operators import reshape as R
from marketlens.registry import query

from .bindings import t


@query("filter_typed", "SELECT event_id, value FROM events WHERE value >= 50 AND event_type IN ('purchase', 'view') AND user_id <> 3")
def _(spark, sf):
    e = R.filter_typed(t(spark, sf, "events"), "value", "gte", 50)
    return R.filter_typed(R.filter_typed(e, "event_type", "in", ["purchase", "view"]), "user_id", "ne", 3).select("event_id", "value")


@query("event_slot_filter", "SELECT event_id FROM events WHERE event_type = 'error'")
def _(spark, sf):
    return R.event_slot_filter(t(spark, sf, "events"), {"event_type": "error", "user_id": None}).select("event_id")


@query("exclude_null_safe", "SELECT event_id, vendor FROM (SELECT event_id, nullif(event_type, 'view') AS vendor FROM events) WHERE vendor IS DISTINCT FROM 'error'")
def _(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("vendor"))
    return R.exclude_null_safe(e, "vendor", "error")


_MEASURES = {"l_quantity": ("term", "quantity"), "l_extendedprice": ("term", "price"), "l_discount": ("cumulative", "discount"), "l_tax": ("cumulative", "tax")}


@query("unpivot_measures", "\nUNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{p}' AS period_kind, '{a}' AS amount_kind, {c} AS amount FROM lineitem WHERE {c} IS NOT NULL" for c, (p, a) in _MEASURES.items()))
def _(spark, sf):
    return R.unpivot_measures(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _MEASURES)


_WIDE = "SELECT CAST(ts AS DATE) AS d, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1"


def _wide(spark, sf, *key):
    return t(spark, sf, "events").groupBy(*(key or [F.to_date("ts").alias("d")])).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count("event_id"))


@query("unpivot_all_columns", "SELECT CAST(ts AS DATE) AS d, event_type AS ticker, count(*) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    return R.unpivot_all_columns(_wide(spark, sf), ["d"])


@query(
    "unpivot_actor_columns",
    "WITH w AS (SELECT user_id, event_type AS actor, count(*) AS flow FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2), l AS (SELECT user_id, event_type AS actor, CAST(floor(max(value)) AS BIGINT) AS flow FROM events WHERE event_type IN ('view', 'error') GROUP BY 1, 2) SELECT user_id, actor, max(flow) AS flow FROM (SELECT * FROM w UNION ALL SELECT * FROM l) GROUP BY 1, 2",
)
def _(spark, sf):
    long = t(spark, sf, "events").where("event_type IN ('view', 'error')").groupBy("user_id", F.col("event_type").alias("actor")).agg(F.floor(F.max("value")).alias("flow"))
    return R.unpivot_actor_columns(_wide(spark, sf, "user_id"), long, ["user_id"], ["click", "view"])


@query("pivot_items", "SELECT user_id, CAST(ts AS DATE) AS d, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'purchase') AS purchase, round(max(value) FILTER (event_type = 'purchase') / max(value) FILTER (event_type = 'view'), 6) AS ratio FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return R.pivot_items(e, ["user_id", "d"], ["view", "purchase"], item="event_type", derived={"ratio": F.round(S.ratio(F.col("purchase"), F.col("view")), 6)})


@query("assemble_wide", "WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS spend FROM orders GROUP BY 1), b AS (SELECT user_id AS k, max(value) AS activity FROM events GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, spend, activity FROM a FULL JOIN b ON a.k = b.k")
def _(spark, sf):
    a = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("value"))
    b = t(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("value"))
    return R.assemble_wide({"spend": a, "activity": b}, ["k"])


@query(
    "normalize_numeric",
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,234.5' WHEN 1 THEN 'n/a' WHEN 2 THEN CAST(o_custkey AS VARCHAR) ELSE NULL END AS price, CASE o_orderkey % 3 WHEN 0 THEN '1.5' ELSE CAST(o_custkey AS VARCHAR) END AS volume FROM orders)
    SELECT o_orderkey, TRY_CAST(replace(price, ',', '') AS DOUBLE) AS price, CASE WHEN volume <> '1.5' THEN CAST(volume AS BIGINT) END AS volume,
    concat_ws(',', CASE WHEN price = 'n/a' THEN 'price' END, CASE WHEN volume = '1.5' THEN 'volume' END) AS bad FROM x""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    x = t(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 4 == 0, "1,234.5").when(k % 4 == 1, "n/a").when(k % 4 == 2, F.col("o_custkey").cast("string")).alias("price"), F.when(k % 3 == 0, "1.5").otherwise(F.col("o_custkey").cast("string")).alias("volume")
    )
    return R.normalize_numeric(x, ["price", "volume"], whole=["volume"]).withColumn("bad", F.array_join("bad", ","))


@query("scale_units", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,4)) * 1000000 AS DOUBLE) AS o_totalprice FROM orders")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,4)").alias("o_totalprice"))
    return R.scale_units(o, ["o_totalprice"], 1_000_000).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("union_sources", "SELECT user_id AS k, value, NULL AS segment FROM events UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    return R.union_sources([t(spark, sf, "events").select(F.col("user_id").alias("k"), "value"), t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("segment"))])


def _objects(spark, sf):
    nodes = {"customer": (t(spark, sf, "customer"), "c_custkey", None), "order": (t(spark, sf, "orders"), "o_orderkey", "o_orderdate"), "part": (t(spark, sf, "part"), "p_partkey", None)}
    edges = {"placed": (t(spark, sf, "orders"), "customer", "o_custkey", "order", "o_orderkey", "o_orderdate"), "contains": (t(spark, sf, "lineitem"), "order", "l_orderkey", "part", "l_partkey", "l_shipdate")}
    return R.ObjectSet(nodes, edges, dt.datetime(1998, 1, 1))


@query(
    "object_set",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)))",
)
def _(spark, sf):
    s = _objects(spark, sf).of("customer").where("c_mktsegment", "eq", "BUILDING").where("c_acctbal", "gt", 9000).follow("placed").follow("contains")
    return s.frame.select("p_partkey", "p_name")


@query("object_affordances", "SELECT 'field' AS kind, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'relation', 'placed', (SELECT count(*) FROM customer)")
def _(spark, sf):
    s = _objects(spark, sf).of("customer")
    rows = [("field", f) for f in s.affordances()["fields"]] + [("relation", r) for r in s.affordances()["relations"]]
    return spark.createDataFrame(rows, "kind string, name string").join(F.broadcast(s.frame.agg(F.count("*").alias("n"))))


@query("column_catalog_probe", "WITH l AS (SELECT l_partkey % 500 AS k, max(l_shipdate) AS last FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01' GROUP BY 1) SELECT p_partkey AS item_code, p_name AS item_name, coalesce(last = (SELECT max(last) FROM l), false) AS alive FROM part LEFT JOIN l ON p_partkey = k WHERE contains(lower(p_name), 'ring')")
def _(spark, sf):
    d = t(spark, sf, "part").select(F.col("p_partkey").alias("item_code"), F.col("p_name").alias("item_name"))
    i = t(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("item_code"), F.col("l_shipdate").alias("trade_date"))
    return R.column_catalog_probe(d, i, dt.datetime(1998, 1, 1), "ring")


# Column functions

@query("bare_ticker", "SELECT p_partkey, regexp_replace(regexp_replace('A' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.KS', '\\.[A-Z]+$', ''), '^[A-Z]', '') AS ticker FROM part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.bare_ticker(F.concat(F.lit("A"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".KS"))).alias("ticker"))


@query(
    "normalize_url",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, regexp_extract(url, '://([^/?#]*)', 1) AS h, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
    k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_[a-z]+|fbclid|gclid|ref|igshid|mc_cid|mc_eid)$'))) AS l FROM u)
    SELECT page_id, lower(s) || '://' || lower(h) || p || CASE WHEN len(l) > 0 THEN '?' || array_to_string(l, '&') ELSE '' END AS url FROM k""",
)
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", S.normalize_url(F.col("url")).alias("url"))


@query("match_text", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS matched FROM documents WHERE lang = 'en' AND length(text) = octet_length(encode(text))")
def _(spark, sf):
    d = t(spark, sf, "documents").where("lang = 'en' AND char_length(text) = octet_length(text)")
    return d.select("doc_id", F.md5(S.match_text(F.col("text"))).alias("matched"))


@query("article_id", "SELECT doc_id, sha256(lang || '|' || source) AS article_id FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.article_id(F.lit(""), F.col("lang"), F.col("source")).alias("article_id"))


@query("stable_id", "SELECT event_id, 'ev_' || substr(sha256('=' || user_id || chr(31) || '=' || event_type || chr(31) || coalesce('=' || nullif(event_type, 'view'), '~')), 1, 24) AS id FROM events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", S.stable_id("ev_", F.col("user_id"), F.col("event_type"), F.nullif("event_type", F.lit("view"))).alias("id"))


@query("content_hash", "SELECT doc_id, sha256('=' || trim(text, ' ') || chr(31) || '=' || lang) AS hash FROM documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.content_hash(F.col("text"), F.col("lang")).alias("hash"))


@query("local_date", "SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS d FROM events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", S.local_date(F.col("ts").cast("timestamp"), "Asia/Seoul").alias("d"))


@query("floor_bucket", "SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events")
def _(spark, sf):
    from marketlens.operators.bars import floor_bucket

    return t(spark, sf, "events").select("event_id", floor_bucket(F.col("ts").cast("timestamp"), 5).alias("b"))


@query("period_key", "SELECT o_orderkey, year(o_orderdate) || CASE quarter(o_orderdate) WHEN 1 THEN 'Q1' WHEN 2 THEN 'H1' WHEN 3 THEN 'Q3' ELSE 'FY' END AS period FROM orders")
def _(spark, sf):
    q = F.quarter("o_orderdate")
    code = F.when(q == 1, "11013").when(q == 2, "11012").when(q == 3, "11014").otherwise("11011")
    return t(spark, sf, "orders").select("o_orderkey", S.period_key(F.year("o_orderdate"), code).alias("period"))


@query("fiscal_available_from", "SELECT o_orderkey, make_date(year(o_orderdate) + 1, 4, 1) AS available_from FROM orders")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", S.fiscal_available_from(F.year("o_orderdate"), 4).alias("available_from"))


@query("log_return", "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice / l_quantity), 9) AS lr, round(exp(ln(l_extendedprice / l_quantity) / 10) - 1, 7) AS pct FROM lineitem")
def _(spark, sf):
    lr = S.log_return(F.col("l_quantity"), F.col("l_extendedprice"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(lr, 9).alias("lr"), F.round(S.pct_of_log(lr / 10), 7).alias("pct"))


@query("pct_of_log", "SELECT event_id, round(exp(ln(1 + value)) - 1, 6) AS pct FROM events WHERE value >= 0")
def _(spark, sf):
    e = t(spark, sf, "events").where("value >= 0")
    return e.select("event_id", F.round(S.pct_of_log(F.log1p("value")), 6).alias("pct"))


@query("revision", "WITH c AS (SELECT c_custkey, c_acctbal - 3000 AS a, c_custkey % 100 - 50.0 AS b FROM customer) SELECT c_custkey, round(CASE WHEN a > 0 AND b > 0 THEN ln(a / b) WHEN b <> 0 THEN (a - b) / abs(b) END, 6) AS rev FROM c")
def _(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.round(S.revision(F.col("c_acctbal") - 3000, F.col("c_custkey") % 100 - F.lit(50.0)), 6).alias("rev"))


@query(
    "mentions_union",
    """SELECT user_id, CASE WHEN user_id % 10 < user_id % 7 THEN '[{"market":"KR","ticker":"' || user_id % 10 || '"},{"market":"KR","ticker":"' || user_id % 7 || '"}]'
    WHEN user_id % 10 = user_id % 7 THEN '[{"market":"KR","ticker":"' || user_id % 10 || '"}]' ELSE '[{"market":"KR","ticker":"' || user_id % 7 || '"},{"market":"KR","ticker":"' || user_id % 10 || '"}]' END AS mentions FROM (SELECT DISTINCT user_id FROM events)""",
)
def _(spark, sf):
    one = lambda n: F.concat(F.lit('[{"market":"KR","ticker":"'), (F.col("user_id") % n).cast("string"), F.lit('"}]'))
    return t(spark, sf, "events").select("user_id").distinct().select("user_id", S.mentions_union(one(10), one(7)).alias("mentions"))
