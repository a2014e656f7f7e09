"""Streams over the events table, and their batch twins."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from marketlens.operators import pit
from marketlens.registry import query
from marketlens.sources.sink import shared_dir
from marketlens.streaming import minute as M
from marketlens.streaming import stateful as S

from .bindings import BARS, DAY, bars, prices, t
from .events_q import _NOV, STAGES, novel, topics
from .gates_q import _W, hours

_SCHEMA = "symbol long, ts timestamp, open double, high double, low double, close double, volume long"


def _folder(spark, df) -> str:
    """df as a folder of files that a stream can read."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/in")
    return path


def _bars(spark, sf):
    return bars(spark, sf).select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("stream_bars", f"WITH {BARS} SELECT symbol, ts, close FROM bars")
def _(spark, sf):
    path = _folder(spark, _bars(spark, sf).unionByName(_bars(spark, sf).where("symbol % 10 = 0")))
    M.run_available(M.stream_bars(spark, f"{path}/in", _SCHEMA, "60 days"), path)
    return spark.read.schema(_SCHEMA).parquet(f"{path}/data").select("symbol", "ts", "close")


_TUMBLE = "SELECT symbol, time_bucket(INTERVAL 60 MINUTE, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE AS available_at FROM bars"


@query("stream_tumbling_ohlcv", f"WITH {BARS}, w AS ({_TUMBLE} GROUP BY symbol, time_bucket(INTERVAL 60 MINUTE, ts)) SELECT * FROM w WHERE available_at <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def _(spark, sf):
    path = _folder(spark, _bars(spark, sf))
    stream = spark.readStream.schema(_SCHEMA).parquet(f"{path}/in")
    M.run_available(M.stream_tumbling_ohlcv(stream, 60, "10 minutes"), path)
    return spark.read.parquet(f"{path}/data")


@query("tumbling_ohlcv_batch", f"WITH {BARS} {_TUMBLE} GROUP BY symbol, time_bucket(INTERVAL 60 MINUTE, ts)")
def _(spark, sf):
    return M.stream_tumbling_ohlcv(_bars(spark, sf), 60)


@query(
    "classify_units",
    "WITH b AS (SELECT user_id AS symbol, date_trunc('day', ts) AS ts, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2), w AS (SELECT DISTINCT ts FROM b), u AS (SELECT DISTINCT user_id AS symbol FROM events) SELECT w.ts, u.symbol, CASE WHEN v IS NULL THEN 'missing' WHEN u.symbol % 7 = 0 OR v <= 0 THEN 'invalid' WHEN u.symbol % 5 = 0 THEN 'no_trade' ELSE 'received' END AS status FROM w CROSS JOIN u LEFT JOIN b ON b.ts = w.ts AND b.symbol = u.symbol",
)
def _(spark, sf):
    e = t(spark, sf, "events")
    b = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("symbol"), F.date_trunc("day", "ts").alias("ts")).agg(F.max("value").alias("v"))
    k, v = F.col("symbol"), F.col("v")
    b = b.select("symbol", "ts", v.alias("open"), F.when(k % 7 == 0, v - 1).otherwise(v).alias("high"), F.when(k % 7 == 0, v - 1).otherwise(v).alias("low"), v.alias("close"), F.when(k % 5 == 0, 0).otherwise(3).alias("volume"))
    return M.classify_units(b, e.select(F.col("user_id").alias("symbol")), b)


def _sessions(spark, sf):
    b = _bars(spark, sf).withColumn("session", F.to_date("ts"))
    base = M.session_open_fallback(b, pit.prev_close_baseline(prices(spark, sf), DAY))
    return b.where(F.col("session") >= F.lit(DAY)), base


@query("session_open_fallback", f"WITH {BARS}, p AS (SELECT symbol, arg_max(close, ts) AS prev_close FROM bars WHERE trade_date < DATE '{DAY}' GROUP BY 1) SELECT trade_date AS session, symbol, coalesce(any_value(prev_close), arg_min(open, ts)) AS base, CASE WHEN any_value(prev_close) IS NOT NULL THEN 'PREV_CLOSE' ELSE 'SESSION_OPEN' END AS base_kind FROM bars LEFT JOIN p USING (symbol) GROUP BY 1, 2")
def _(spark, sf):
    return _sessions(spark, sf)[1]


_TRIGGER = f"""WITH RECURSIVE {BARS}, p AS (SELECT symbol, arg_max(close, ts) AS base FROM bars WHERE trade_date < DATE '{DAY}' GROUP BY 1),
o AS (SELECT symbol, trade_date AS session, ts, close, base, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY ts) AS n FROM bars JOIN p USING (symbol) WHERE trade_date >= DATE '{DAY}' AND close > 0 AND base > 0),
s AS (SELECT symbol, session, CAST(0 AS BIGINT) AS n, base, base AS anchor, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS close, CAST(NULL AS VARCHAR) AS event FROM o WHERE n = 1
UNION ALL SELECT o.symbol, o.session, o.n, o.base, CASE WHEN abs(o.close / o.base - 1) <= 0.01 THEN o.base WHEN abs(o.close / s.anchor - 1) >= 0.03 THEN o.close ELSE s.anchor END, o.ts, o.close,
    CASE WHEN abs(o.close / o.base - 1) <= 0.01 THEN CASE WHEN s.anchor <> o.base THEN 'REVERT' END WHEN abs(o.close / s.anchor - 1) >= 0.03 THEN 'FIRE' END
    FROM s JOIN o ON o.symbol = s.symbol AND o.session = s.session AND o.n = s.n + 1)"""


@query("price_trigger", f"{_TRIGGER} SELECT session, symbol, ts, close, event, anchor FROM s WHERE event IS NOT NULL")
def _(spark, sf):
    b, base = _sessions(spark, sf)
    return M.price_trigger(b, base.where("base_kind = 'PREV_CLOSE'"))


@query("stream_price_trigger", f"{_TRIGGER} SELECT session, symbol, ts, close, event, anchor FROM s WHERE event IS NOT NULL")
def _(spark, sf):
    b, base = _sessions(spark, sf)
    rows = b.join(base.where("base_kind = 'PREV_CLOSE'"), ["session", "symbol"]).select("session", "symbol", "ts", "close", "base")
    path = _folder(spark, rows)
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    M.run_available(M.stream_price_trigger(stream), path)
    return spark.read.schema("session date, symbol long, ts timestamp, close double, event string, anchor double").parquet(f"{path}/data")


@query("idempotent_fire", f"{_TRIGGER} SELECT session, symbol, ts, 1 AS n FROM s WHERE event = 'FIRE' AND symbol % 2 = 0")
def _(spark, sf):
    b, base = _sessions(spark, sf)
    fires = M.price_trigger(b, base.where("base_kind = 'PREV_CLOSE'")).where("event = 'FIRE'")
    done = M.idempotent_fire(fires.where("symbol % 2 = 1"))
    return M.idempotent_fire(fires.unionByName(fires), done).select("session", "symbol", "ts", F.lit(1).alias("n"))


_OBS = "ob AS (SELECT event_id AS seq, user_id AS item_id, ts, CAST(floor(value / 30) AS BIGINT) AS hash, (event_id - CASE WHEN event_id % 6 = 0 THEN 400 ELSE 0 END) // 40 AS seen, CASE WHEN event_id % 9 = 0 THEN 'url:' || user_id WHEN event_id % 50 = 1 THEN 'url:b' END AS url_id FROM events)"
_OUTCOMES = f"""WITH {_OBS}, a AS (SELECT *, first_value(url_id IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known, row_number() OVER (PARTITION BY item_id ORDER BY ts, seq) AS nth FROM ob),
b AS (SELECT *, coalesce(url_id <> known, false) AS clash, url_id IS NOT NULL AND known IS NULL AND nth > 1 AS promoted FROM a),
c AS (SELECT *, max(seen) FILTER (NOT clash) OVER (PARTITION BY item_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM b),
d AS (SELECT c.*, (SELECT arg_min(x.hash, (x.ts, x.seq)) FROM b x WHERE x.item_id = c.item_id AND NOT x.clash AND x.seen = c.newest AND x.seq < c.seq) AS last FROM c),
o AS (SELECT *, CASE WHEN nth = 1 THEN 'NEW' WHEN clash THEN 'IDENTITY_CONFLICT' WHEN seen < newest THEN 'STALE' WHEN hash <> last AND seen = newest THEN 'CHECKSUM_CONFLICT' WHEN hash <> last THEN 'CONTENT_CHANGED' WHEN promoted THEN 'ID_PROMOTED' ELSE 'UNCHANGED' END AS observation FROM d)
SELECT seq, item_id, observation, promoted, CAST(sum(CASE WHEN observation IN ('NEW', 'CONTENT_CHANGED') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ts, seq) AS INT) AS generation, coalesce(known, url_id, 'item:' || item_id) AS article_id FROM o"""


def _observations(spark, sf):
    k = F.col("event_id")
    url = F.when(k % 9 == 0, F.concat(F.lit("url:"), F.col("user_id").cast("string"))).when(k % 50 == 1, F.lit("url:b"))
    seen = F.floor((k - F.when(k % 6 == 0, 400).otherwise(0)) / 40)
    return t(spark, sf, "events").select(k.alias("seq"), F.col("user_id").alias("item_id"), "ts", F.floor(F.col("value") / 30).alias("hash"), seen.alias("seen"), url.alias("url_id"))


def _told(spark, stream, path, schema):
    """What a stream with state said of all that is there."""
    with S.rocksdb(spark):
        M.run_available(stream, path)
    return spark.read.schema(schema).parquet(f"{path}/data")


def _in_turns(spark, df, turns=3):
    """df as a stream in some three batches that don't follow the rows' times, and the stream's folder."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _folder(spark, df.repartition(max(n, turns), *df.columns[:1]))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-max(n, turns) // turns)).parquet(f"{path}/in"), path


@query("news_observe", _OUTCOMES)
def _(spark, sf):
    stream, path = _in_turns(spark, _observations(spark, sf))
    out = S.stream_news_observe(stream, "60 days")
    return S.last_revisions(_told(spark, out, path, out.schema), ["item_id", "seq"]).drop("revision")


@query("news_observe_batch", _OUTCOMES)
def _(spark, sf):
    return M.news_observe(_observations(spark, sf)).select("seq", "item_id", "observation", "promoted", "generation", "article_id")


@query(
    "overlap_poll_dedup",
    "WITH p AS (SELECT o_orderkey // 100 AS page, o_orderkey % 70 AS item_id, o_orderpriority AS hash FROM orders), s AS (SELECT min(page) AS stop FROM p WHERE item_id = 13 AND page > 0) SELECT item_id, min(page) AS first_page, min(hash) AS hash, false AS truncated, CASE WHEN count(DISTINCT hash) > 1 THEN 'CONFLICT' ELSE 'OK' END AS state FROM p, (SELECT min(page) AS stop FROM p WHERE item_id = 13) WHERE page <= stop GROUP BY 1",
)
def _(spark, sf):
    p = t(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("page"), (F.col("o_orderkey") % 70).alias("item_id"), F.col("o_orderpriority").alias("hash"))
    return M.overlap_poll_dedup(p, p.where("item_id = 13").select("item_id").distinct())


_THREADS = f"""WITH {_NOV} SELECT user_id, topic, min(ts) AS opened_at, max(ts) AS last_state_at, arg_min(event_type, (-k, ts, event_id)) FILTER (k > 0) AS current_stage, count(*) AS n_events, count(*) FILTER (novelty = 'FOLLOW_UP_STAGE') AS n_follow_ups FROM nov WHERE topic IS NOT NULL GROUP BY 1, 2"""


@query("thread_events", _THREADS)
def _(spark, sf):
    e = topics(spark, sf)
    stream, path = _in_turns(spark, e)
    out = S.stream_thread_events(stream, ["user_id", "topic"], STAGES, "60 days")
    said = S.last_revisions(_told(spark, out, path, out.schema), ["user_id", "topic", "event_id"]).join(e.select("event_id", "ts"), "event_id")
    last = F.max_by(F.struct("current_stage", "prior_count"), F.struct("ts", "event_id"))
    g = said.groupBy("user_id", "topic").agg(F.timestamp_micros(F.max("opened_at")).alias("opened_at"), F.max("ts").alias("last_state_at"), last.alias("x"), F.count_if(F.col("novelty") == "FOLLOW_UP_STAGE").alias("n_follow_ups"))
    return g.select("user_id", "topic", "opened_at", "last_state_at", "x.current_stage", (F.col("x.prior_count") + 1).alias("n_events"), "n_follow_ups")


@query("thread_events_batch", _THREADS)
def _(spark, sf):
    n = novel(spark, sf).where("topic IS NOT NULL")
    rank = F.coalesce(*[F.when(F.col("stage") == s, k) for s, k in STAGES.items()])
    first = F.min_by(F.when(rank.isNotNull(), F.col("stage")), F.when(rank.isNotNull(), F.struct((-rank).alias("r"), "ts", "event_id")))
    return n.groupBy("user_id", "topic").agg(F.min("ts").alias("opened_at"), F.max("ts").alias("last_state_at"), first.alias("current_stage"), F.count("*").alias("n_events"), F.count_if(F.col("novelty") == "FOLLOW_UP_STAGE").alias("n_follow_ups"))


@query("stream_confirm_missing", f"WITH {_W} SELECT session_id, window_start, CASE WHEN status = 'DUE' THEN 'MISSING' ELSE status END AS status FROM w WHERE window_end <= TIMESTAMP '2024-01-15 00:00:00'")
def _(spark, sf):
    # The ledger up to some days after the sessions' end, then the rest, with another word on windows that were missing.
    end, cut = F.lit(dt.datetime(2024, 1, 15)), F.lit(dt.datetime(2024, 1, 20))
    w = hours(spark, sf).select("session_id", "window_start", "status", F.col("window_end").alias("scheduled_at"), end.alias("session_end"), F.lit(1).alias("version"), F.col("window_start").alias("ts"))
    later = w.where(F.col("status") == "DUE").withColumn("status", F.lit("VALID")).withColumn("version", F.lit(2)).withColumn("ts", F.lit(dt.datetime(2024, 1, 25)))
    path = _folder(spark, w.where(F.col("ts") < cut))
    first, second = spark.readStream.schema(w.schema).parquet(f"{path}/in"), f"{path}/in"
    out = S.stream_confirm_missing(first, "3 days")
    _told(spark, out, path, out.schema)
    w.where(F.col("ts") >= cut).unionByName(later).write.mode("append").parquet(second)
    said = _told(spark, out, path, out.schema)
    return said.select("session_id", F.timestamp_micros("window_start").alias("window_start"), "status")


@query("revert_exposure", "WITH r AS (SELECT user_id, max(ts) AS x FROM events WHERE event_type = 'error' AND event_id % 50 = 0 GROUP BY 1) SELECT event_id, CASE WHEN event_type = 'purchase' AND x >= ts THEN 'WITHDRAWN' WHEN event_type = 'purchase' THEN 'PUBLISHED' ELSE 'DRAFT' END AS status FROM events LEFT JOIN r USING (user_id)")
def _(spark, sf):
    e = t(spark, sf, "events").withColumnRenamed("user_id", "symbol")
    res = e.select("event_id", "symbol", "ts", F.when(F.col("event_type") == "purchase", "PUBLISHED").otherwise("DRAFT").alias("status"))
    return M.revert_exposure(e.where("event_type = 'error' AND event_id % 50 = 0"), res).select("event_id", "status")


@query("nav_minute", "SELECT event_id, CAST(CAST(value AS DECIMAL(24,8)) AS DOUBLE) AS nav FROM events WHERE strftime(ts, '%H%M') = '0930'")
def _(spark, sf):
    rows = t(spark, sf, "events").select("event_id", F.date_format("ts", "HHmm").alias("label"), F.col("value").alias("nav"))
    return M.nav_minute(rows, dt.datetime(2024, 1, 20, 9, 30)).select("event_id", F.col("nav").cast("double").alias("nav"))
