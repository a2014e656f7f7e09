"""The tables in the roles that operators ask for, as DataFrames and as SQL (common table expressions)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import bars as B
from marketlens.sources.sink import written

DAY = dt.date(2024, 1, 20)
AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Minute-like bars, one for each event: symbol, ts, open to close, volume, trade_date, available_at (a minute later)."""
    v = F.col("value")
    events = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").alias("symbol"), "ts", v.alias("open"), (v * 1.01).alias("high"), (v * 0.99).alias("low"), v.alias("close"), F.lit(1).cast("long").alias("volume"), F.to_date("ts").alias("trade_date"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("available_at"), "event_id", "event_type"
    )


BARS = """bars AS (SELECT user_id AS symbol, ts, value AS open, value * 1.01 AS high, value * 0.99 AS low, value AS close, CAST(1 AS BIGINT) AS volume,
    CAST(ts AS DATE) AS trade_date, ts + INTERVAL 1 MINUTE AS available_at, event_id, event_type FROM events)"""


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).groupBy("symbol", "trade_date").agg(*B.ohlcv("ts"))


PRICES = (
    BARS
    + """, prices AS (SELECT symbol, trade_date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL)"""
)

def ln_ratio(a: str, b: str) -> str:
    """SQL: the log of a over b, null unless the ratio is positive."""
    return f"ln(CASE WHEN {a} / nullif({b}, 0) > 0 THEN {a} / nullif({b}, 0) END)"


RETURNS = (
    PRICES
    + f""", returns AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, {ln_ratio("close", "lag(close) OVER w")} AS lr FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
market AS (SELECT trade_date, avg(r) AS market_mean, avg(lr) AS market_lmean, count(r) AS n FROM returns GROUP BY 1),
abnormal AS (SELECT r.*, CASE WHEN n >= 20 THEN r - market_mean END AS ar, CASE WHEN n >= 20 THEN lr - market_lmean END AS alr FROM returns r LEFT JOIN market USING (trade_date))"""
)
MIN_N = 20


def returns(spark: SparkSession, sf: str) -> DataFrame:
    from marketlens.operators import panel

    return panel.abnormal_returns(panel.daily_returns(prices(spark, sf)), MIN_N)


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, sector: customers' segments."""
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("sector"), F.log(F.greatest(F.col("c_acctbal"), F.lit(1.0))).alias("ln_size"))


SECTORS = "sectors AS (SELECT c_custkey AS symbol, c_mktsegment AS sector, ln(greatest(c_acctbal, 1.0)) AS ln_size FROM customer)"


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """fund, constituent, as_of_date (the year's first day), weight: shares of a customer's (mod 40) spend on parts.

    Spends are written, a row for each fund, constituent and year: what reads holdings several times joins the orders' lines once.
    """
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("fund"))
    # Lines travel by order as narrow as they can: a constituent, a year, and a value.
    li = t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 150).alias("constituent"), F.to_date(F.date_trunc("year", "l_shipdate")).alias("as_of_date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    h = written(li.join(o, li.l_orderkey == o.o_orderkey).groupBy("fund", "constituent", "as_of_date").agg(F.sum("value").alias("value")))
    total = h.groupBy("fund", "as_of_date").agg(F.sum("value").alias("total"))
    return h.join(total, ["fund", "as_of_date"]).select("fund", "constituent", "as_of_date", (F.col("value").cast("double") / F.col("total").cast("double")).alias("weight"))


HOLDINGS = """h0 AS (SELECT o_custkey % 40 AS fund, l_partkey % 150 AS constituent, CAST(date_trunc('year', l_shipdate) AS DATE) AS as_of_date, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
holdings AS (SELECT fund, constituent, as_of_date, CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY fund, as_of_date) AS DOUBLE) AS weight FROM h0)"""
