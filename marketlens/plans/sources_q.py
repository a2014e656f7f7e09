"""Sources and sinks: tables written to a folder of the shared directory and read back as each source."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from marketlens.operators import quality as Q
from marketlens.registry import query
from marketlens.sources import scan, sink

from .bindings import DAY, t


def _new(spark) -> str:
    return f"{sink.shared_dir(spark)}/source-{uuid.uuid4().hex}"


def _daily(spark, sf):
    return t(spark, sf, "events").select("event_id", "user_id", "value", "event_type", F.to_date("ts").alias("trade_date"))


_DAILY = "SELECT event_id, user_id, value, event_type, CAST(ts AS DATE) AS trade_date FROM events"


@query("scan_partitioned", f"SELECT * FROM ({_DAILY}) WHERE trade_date >= DATE '2024-01-20'")
def _(spark, sf):
    base = _new(spark)
    sink.write_partition_overwrite(_daily(spark, sf), base, ["trade_date"])
    return scan.scan_partitioned(spark, base).where("trade_date >= DATE '2024-01-20'")


@query("scan_glob", "SELECT event_id, value FROM events WHERE event_type = 'view'")
def _(spark, sf):
    base = _new(spark)
    e = _daily(spark, sf)
    e.where("event_type = 'view'").select("event_id", "value").write.parquet(f"{base}/views")
    e.limit(10).select(F.col("user_id").cast("string").alias("value")).write.json(f"{base}/strays")
    return scan.scan_glob(spark, base, "*.parquet", "event_id long, value double")


@query("scan_csv_strings", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(NULL AS VARCHAR) AS missing FROM events")
def _(spark, sf):
    base = _new(spark)
    _daily(spark, sf).select("event_id", "event_type").write.option("compression", "gzip").option("header", True).csv(base)
    return scan.scan_csv_strings(spark, base, ["event_id", "event_type", "missing"])


@query("scan_csv_dict", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, sf):
    base = _new(spark)
    t(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").coalesce(1).write.option("header", True).csv(base)
    return scan.scan_csv_dict(spark, base, "p_partkey long, p_name string, p_retailprice double")


@query("scan_ndjson", "SELECT CASE WHEN event_id % 100 > 0 THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN event_id % 100 > 0 THEN event_type END AS event_type, event_id % 100 = 0 AS corrupt FROM events")
def _(spark, sf):
    base = _new(spark)
    line = F.to_json(F.struct("event_id", "event_type"))
    _daily(spark, sf).select(F.when(F.col("event_id") % 100 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.text(base)
    return scan.scan_ndjson(spark, base, ["event_id", "event_type"]).select("event_id", "event_type", F.col("_corrupt").isNotNull().alias("corrupt"))


@query("scan_versioned_table", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    base = _new(spark)
    for k in (0, 1):
        _daily(spark, sf).where(F.col("event_id") % 2 == k).write.mode("append").parquet(base)
    return scan.scan_versioned_table(spark, base, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("scan_or_empty", "SELECT 'found' AS source, count(*) AS n FROM region UNION ALL SELECT 'empty', 0")
def _(spark, sf):
    schema = "r_regionkey int, r_name string"
    found, where = scan.scan_or_empty(spark, [f"{sf}/no_such.parquet", f"{sf}/region.parquet"], schema)
    none, nowhere = scan.scan_or_empty(spark, [f"{sf}/no_such.parquet"], schema)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    return n(found, "found" if where.endswith("region.parquet") else "?").union(n(none, nowhere))


@query(
    "coverage_report",
    "SELECT 'events' AS source, least(count(*), 5000) AS rows, least(count(DISTINCT CAST(ts AS DATE)), 20) AS days, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, CASE WHEN count(*) < 5000 THEN 'too few rows' WHEN count(DISTINCT CAST(ts AS DATE)) < 20 THEN 'too few days' END AS missing FROM events UNION ALL SELECT 'orders', least(count(*), 10000000), least(count(DISTINCT CAST(o_orderdate AS DATE)), 10), min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), 'too few rows' FROM orders",
)
def _(spark, sf):
    return scan.coverage_report({"events": (t(spark, sf, "events"), "ts"), "orders": (t(spark, sf, "orders"), "o_orderdate")}, {"events": (5000, 20), "orders": (10_000_000, 10)})


@query("source_frontier", "SELECT greatest(min(CAST(o_orderdate AS DATE)), (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)) AS overlap_from, least(max(CAST(o_orderdate AS DATE)), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS overlap_to, false AS disjoint FROM orders")
def _(spark, sf):
    return scan.source_frontier(t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")), t(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")), "d")


@query("load_dimension_snapshot", "SELECT upper(trim(o_orderpriority)) AS priority, o_custkey, o_orderkey, DATE '2024-01-20' AS as_of_date FROM orders WHERE o_orderpriority <> '5-LOW' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey) = 1")
def _(spark, sf):
    priority = F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.concat(F.lit(" "), F.lower("o_orderpriority"))).alias("priority")
    return scan.load_dimension_snapshot(t(spark, sf, "orders").select("o_custkey", priority, "o_orderkey"), "priority", DAY)


@query("gate_partial_landing", "SELECT count(DISTINCT user_id) AS symbols, count(*) FILTER (user_id = 7) > 0 AS has_proxy, count(DISTINCT user_id) >= 50 AND count(*) FILTER (user_id = 7) > 0 AS landed FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20' AND event_type IS DISTINCT FROM 'error'")
def _(spark, sf):
    return scan.gate_partial_landing(_daily(spark, sf), DAY, 50, 7, "error", symbol="user_id", vendor="event_type")


_ARB = "a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, 'A' AS vendor FROM events WHERE event_type <> 'view'), b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, 'B' AS vendor FROM events WHERE event_type <> 'click')"


@query("arbitrate_sources", f"WITH {_ARB} SELECT * FROM a WHERE d < DATE '2024-01-15' OR (user_id, d) NOT IN (SELECT (user_id, d) FROM b) UNION ALL SELECT * FROM b WHERE d >= DATE '2024-01-15' OR (user_id, d) NOT IN (SELECT (user_id, d) FROM a)")
def _(spark, sf):
    e = t(spark, sf, "events").withColumn("d", F.to_date("ts"))
    one = lambda skip, v: e.where(F.col("event_type") != skip).select("user_id", "d", F.lit(v).alias("vendor")).distinct()
    return scan.arbitrate_sources(one("view", "A"), one("click", "B"), ["user_id"], "d", dt.date(2024, 1, 15))


@query("symbol_map", "WITH s AS (SELECT user_id AS ticker, user_id || '.KS' AS symbol, 0 AS p FROM events WHERE user_id % 2 = 0 UNION ALL SELECT c_custkey, c_custkey || '.KQ', 1 FROM customer) SELECT ticker, arg_min(symbol, (p, symbol)) AS symbol FROM s GROUP BY 1")
def _(spark, sf):
    a = t(spark, sf, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("ticker"), F.concat(F.col("user_id").cast("string"), F.lit(".KS")).alias("symbol"))
    b = t(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), F.concat(F.col("c_custkey").cast("string"), F.lit(".KQ")).alias("symbol"))
    return scan.symbol_map([a, b])


@query("write_partition_overwrite", f"SELECT event_id, CASE WHEN trade_date = DATE '2024-01-05' THEN value + 1 ELSE value END AS value, trade_date FROM ({_DAILY})")
def _(spark, sf):
    base = _new(spark)
    e = _daily(spark, sf).select("event_id", "value", "trade_date")
    sink.write_partition_overwrite(e, base, ["trade_date"])
    sink.write_partition_overwrite(e.where("trade_date = DATE '2024-01-05'").withColumn("value", F.col("value") + 1), base, ["trade_date"])
    return scan.scan_partitioned(spark, base, "event_id long, value double, trade_date date")


@query("write_day_rebuild", f"SELECT event_id, value, 'own' AS source_vendor, trade_date FROM ({_DAILY}) WHERE trade_date <> DATE '2024-01-05' OR event_id % 2 = 0")
def _(spark, sf):
    base = _new(spark)
    e = _daily(spark, sf).select("event_id", "value", F.lit("own").alias("source_vendor"), "trade_date")
    sink.write_partition_overwrite(e, base, ["trade_date"])
    sink.write_day_rebuild(e.where("event_id % 2 = 0"), base, dt.date(2024, 1, 5), "own")
    return scan.scan_partitioned(spark, base, "event_id long, value double, source_vendor string, trade_date date")


def _halves(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"))
    return o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 3 < 2").withColumn("price", F.when(F.col("o_orderkey") % 2 == 0, F.col("price") + 1).otherwise(F.col("price")))


@query("merge_append_new", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 1) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def _(spark, sf):
    o = t(spark, sf, "orders")
    return sink.merge_append_new(o.where("o_orderkey % 7 = 1"), o.where("o_orderkey % 3 = 0"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("upsert_changed", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 THEN round(o_totalprice, 2) + 1 ELSE round(o_totalprice, 2) END AS price, CASE o_orderkey % 3 WHEN 0 THEN 'created' WHEN 2 THEN 'kept' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'updated' ELSE 'unchanged' END END AS action FROM orders")
def _(spark, sf):
    return sink.upsert_changed(*_halves(spark, sf), ["o_orderkey"], ["price"])


@query("insert_ignore", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 < 2 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 1)")
def _(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sink.insert_ignore(o.where("o_orderkey % 11 = 1"), o.where("o_orderkey % 3 < 2"), ["o_custkey"]).select("o_custkey")


@query("upsert_extrema", "SELECT user_id, min(ts) AS opened_at, max(ts) AS last_state_at, arg_min(nullif(event_type, 'view'), ts) FILTER (event_type <> 'view') AS stage FROM events GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("opened_at"), F.col("ts").alias("last_state_at"), F.nullif("event_type", F.lit("view")).alias("stage"), "ts")
    return sink.upsert_extrema(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"), ["user_id"], ["opened_at"], ["last_state_at"], ["stage"], "ts")


@query("partition_by_event_date", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN DATE '2024-02-01' ELSE CAST(ts AS DATE) END AS partition_date FROM events")
def _(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("published"), F.lit("2024-02-01").alias("ingested"))
    return sink.partition_by_event_date(e, "published", "ingested").select("event_id", "partition_date")


@query("quality_log_sink", "SELECT 'run-1' AS run_id, 'passed' AS what, count(*) FILTER (value >= 20 AND user_id > 3) AS n FROM events UNION ALL SELECT 'run-1', 'quarantined', count(*) FILTER (NOT (value >= 20 AND user_id > 3)) FROM events UNION ALL SELECT 'run-1', 'reason:low', count(*) FILTER (value < 20) FROM events UNION ALL SELECT 'run-1', 'reason:test_user', count(*) FILTER (user_id <= 3) FROM events")
def _(spark, sf):
    ok, bad = Q.apply_rules(t(spark, sf, "events"), [Q.Rule("low", F.col("value") < 20), Q.Rule("test_user", F.col("user_id") <= 3)])
    return sink.quality_log_sink(ok, bad, "run-1", _new(spark))


@query("long_item_backfill", "SELECT l_orderkey, l_linenumber, l_returnflag, 'l_quantity' AS item_code, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, 'l_tax', l_tax FROM lineitem")
def _(spark, sf):
    return sink.long_item_backfill(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_quantity", "l_tax"], _new(spark), "l_returnflag")
