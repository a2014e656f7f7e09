"""Universes of instruments, long item series, and fields cut out of texts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.scalar import log_ratio

from .stats import running


def universe_build(holdings: DataFrame, declared: DataFrame, reference: DataFrame, fund: str = "fund", member: str = "constituent") -> DataFrame:
    """id, kind (FUND or CONSTITUENT) and version: the declared funds that have holdings, and their members less funds and
    reference funds. A version is a checksum of the ids."""
    funds = declared.select(F.col(fund).alias("id")).distinct().join(holdings.select(F.col(fund).alias("id")), "id", "left_semi")
    members = holdings.join(funds.withColumnRenamed("id", fund), fund, "left_semi").select(F.col(member).alias("id")).distinct()
    members = members.join(declared.select(F.col(fund).alias("id")), "id", "left_anti").join(reference.select(F.col(fund).alias("id")), "id", "left_anti")
    rows = funds.select("id", F.lit("FUND").alias("kind")).unionByName(members.select("id", F.lit("CONSTITUENT").alias("kind")))
    # A sum of hashes doesn't depend on the order of rows, so no task meets all of them.
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", F.col("id").cast("string"))), 1, 12), 16, 10).cast("decimal(38,0)")
    version = rows.agg(F.md5(F.concat_ws(":", F.count("*"), F.sum(digest).cast("string"))).alias("version"))
    return rows.join(F.broadcast(version))  # one row


def universe_errors(holdings: DataFrame, declared: DataFrame, fund: str = "fund", member: str = "constituent") -> DataFrame:
    """Declared funds without holdings (ORPHAN), and ids that are both fund and member (OVERLAP)."""
    d = declared.select(F.col(fund).alias("id")).distinct()
    orphan = d.join(holdings.select(F.col(fund).alias("id")), "id", "left_anti").select("id", F.lit("ORPHAN").alias("error"))
    return orphan.unionByName(d.join(holdings.select(F.col(member).alias("id")), "id", "left_semi").select("id", F.lit("OVERLAP").alias("error")))


def membership_loss(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Members before that are none after."""
    return before.select(*key).distinct().join(after.select(*key), list(key), "left_anti")


def newcomers(universe: DataFrame, latest: DataFrame, history: DataFrame, depth: int, key: str = "symbol", day: str = "trade_date") -> DataFrame:
    """Members that the latest partition lacks (NEW), or whose history has fewer days than depth (SHALLOW)."""
    have = latest.select(key, F.lit(True).alias("_has")).distinct()
    deep = history.groupBy(key).agg(F.countDistinct(day).alias("_days"))
    j = universe.select(key).distinct().join(have, key, "left").join(deep, key, "left")
    return j.withColumn("state", F.when(F.col("_has").isNull(), "NEW").when(F.coalesce("_days", F.lit(0)) < depth, "SHALLOW")).where("state IS NOT NULL").select(key, "state")


def backfill_subtract(backfill: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Backfill rows whose key the existing partitions lack."""
    return backfill.join(existing.select(*key).distinct(), list(key), "left_anti")


def item_series_rank(wide: DataFrame, year: str = "fiscal_year") -> DataFrame:
    """A wide item (a row a year, a column a ticker) as ticker, year, value, with the ticker's share of peers at or below it in the last year."""
    long = wide.unpivot([year], None, "ticker", "value").where("value IS NOT NULL")
    last = long.agg(F.max(year).alias("_last"))
    own = long.join(F.broadcast(last)).where(F.col(year) == F.col("_last")).select("ticker", "value")
    counts = running(own.groupBy("value").agg(F.count("*").alias("_n")), "value", "_n", "_upto")
    total = counts.agg(F.sum("_n").alias("_all"))
    pct = own.join(counts, "value").join(F.broadcast(total)).select("ticker", (F.col("_upto") / F.col("_all")).alias("last_pct"))  # one row
    return long.join(pct, "ticker", "left")


def window_shares(bars: DataFrame, cuts: DataFrame, day: date, key: str = "symbol", ts: str = "ts", price: str = "close", day_col: str = "trade_date") -> DataFrame:
    """A day split at each symbol's cuts (symbol, cut): log return of each span, from the last price before it; shares add up to the day's. A price of 0 gives an infinite return.

    Spans come from the cuts themselves (a running count over bars and cuts in one window), so no ranges are joined.
    """
    own = bars.where(F.col(day_col) == F.lit(day)).select(key, F.col(ts).alias("_t"), F.col(price).alias("_p"))
    marks = cuts.select(key, F.col("cut").alias("_t"), F.lit(None).cast("double").alias("_p"))
    w = Window.partitionBy(key).orderBy("_t", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(marks).withColumn("span", F.count_if(F.col("_p").isNull()).over(w)).where("_p IS NOT NULL")
    ends = both.groupBy(key, "span").agg(F.max_by("_p", "_t").alias("_end"), F.min_by("_p", "_t").alias("_first"))
    prev = F.lag("_end").over(Window.partitionBy(key).orderBy("span"))
    out = ends.withColumn("span_return", log_ratio(F.col("_end"), F.coalesce(prev, F.col("_first"))))
    total = out.groupBy(key).agg(F.sum("span_return").alias("day_return"))
    return out.join(total, key).select(key, "span", "span_return", "day_return", (F.col("span_return") / F.nullif(F.col("day_return"), F.lit(0.0))).alias("share"))


#: Units of Korean amounts, as factors of one won.
UNITS = {"조": 10**12, "억": 10**8, "만": 10**4}
_AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(조|억|만)?\s*원"


def parse_amounts(df: DataFrame, text: str) -> DataFrame:
    """df with amounts: each amount in won named in a text (value, approx: whether 약 stands before it), in order. Years (2024년) have no unit and don't count."""
    found = F.regexp_extract_all(text, F.lit(r"((?:약\s*)?" + _AMOUNT + ")"), 1)

    def value(m):
        unit = F.regexp_extract(m, _AMOUNT, 2)
        factor = F.coalesce(*[F.when(unit == u, F.lit(float(f))) for u, f in UNITS.items()], F.lit(1.0))
        return F.struct((F.regexp_replace(F.regexp_extract(m, _AMOUNT, 1), ",", "").cast("double") * factor).alias("value"), F.startswith(m, F.lit("약")).alias("approx"))

    return df.withColumn("amounts", F.transform(found, value))


def extract_html_fields(pages: DataFrame, tags: Sequence[str], html: str = "html") -> DataFrame:
    """pages with a column for each tag: the text of its first element, without marks inside and with white space collapsed."""
    out = pages
    for tag in tags:
        inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
        out = out.withColumn(f"{tag}_text", F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]*>", " "), r"\s+", " ")))
    return out
