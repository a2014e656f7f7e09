"""Funds: proxies, decomposition of moves into layers, overlap and premium."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_proxy(holdings: DataFrame, returns: DataFrame, value: str = "r", fund: str = "fund", member: str = "constituent", weight: str = "weight") -> DataFrame:
    """Per fund: sum(w r) / sum(w) over members with a return, and the share of weight they make."""
    j = holdings.join(returns.withColumnRenamed("symbol", member), member, "left")
    has = F.col(value).isNotNull()
    return j.groupBy(fund).agg((F.sum(F.col(weight) * F.col(value)) / F.nullif(F.sum(F.when(has, F.col(weight))), F.lit(0.0))).alias("proxy"), (F.coalesce(F.sum(F.when(has, F.col(weight))), F.lit(0.0)) / F.sum(weight)).alias("coverage"))


def fund_decomposition(holdings: DataFrame, returns: DataFrame, value: str = "r", fund: str = "fund", member: str = "constituent", weight: str = "weight") -> DataFrame:
    """Per fund: total of contributions, share of the largest and of the three largest of their sizes, advancers, decliners, coverage."""
    j = holdings.join(returns.withColumnRenamed("symbol", member), member, "left").withColumn("_c", F.col(weight) * F.col(value))
    rank = F.row_number().over(Window.partitionBy(fund).orderBy(F.abs("_c").desc_nulls_last(), member))
    size = F.abs("_c")
    total = F.nullif(F.sum(size), F.lit(0.0))
    return (
        j.withColumn("_k", rank)
        .groupBy(fund)
        .agg(
            F.sum("_c").alias("contribution"),
            (F.sum(F.when(F.col("_k") <= 1, size)) / total).alias("top1"),
            (F.sum(F.when(F.col("_k") <= 3, size)) / total).alias("top3"),
            F.count_if(F.col(value) > 0).alias("advancers"),
            F.count_if(F.col(value) < 0).alias("decliners"),
            (F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))), F.lit(0.0)) / F.sum(weight)).alias("coverage"),
        )
    )


def portfolio_overlap(holdings: DataFrame, fund: str = "fund", member: str = "constituent", weight: str = "weight", least: float = 0.0) -> DataFrame:
    """fund_a < fund_b, overlap: the sum of the lesser weights of common members, common: their number; pairs of an overlap of at least `least`.

    A member stands once in a fund; weights aren't negative. With least above 0, members are put in one order, rarest first,
    and a fund is found only by its prefix: those members after which weights of less than `least` follow. Two funds that
    overlap enough have their first common member in both prefixes. What that member and the lesser of the two rests can
    add up to is checked, too, before holdings are compared. So a member that all funds hold forms no pairs.
    """
    h = holdings.select(F.col(fund).alias("fund"), F.col(member).alias("m"), F.col(weight).alias("w")).where("fund IS NOT NULL AND m IS NOT NULL AND w IS NOT NULL")
    a, b = h.toDF("fund_a", "m", "_wa"), h.toDF("fund_b", "m", "_wb")
    if least <= 0:
        both = a.join(b, "m").where("fund_a < fund_b")
    else:
        near = least - 1e-9  # sums in another order differ a little
        order = [F.col("n"), F.col("m")]
        ranked = h.join(h.groupBy("m").agg(F.count("*").alias("n")), "m")
        rest = F.sum("w").over(Window.partitionBy("fund").orderBy(F.desc("n"), F.desc("m")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
        prefix = ranked.withColumn("rest", rest).where((F.col("rest") + F.col("w") >= near) & (F.col("w") > 0))
        one, two = (prefix.select(F.col("fund").alias(f"fund_{x}"), "m", "n", F.col("w").alias(f"_w{x}"), F.col("rest").alias(f"_r{x}")) for x in "ab")
        met = one.join(two, ["m", "n"]).where("fund_a < fund_b")
        most = F.least("_wa", "_wb") + F.least("_ra", "_rb")
        pairs = met.groupBy("fund_a", "fund_b").agg(F.min_by(most, F.struct(*order)).alias("_most")).where(F.col("_most") >= near).select("fund_a", "fund_b")
        both = pairs.join(a, "fund_a").join(b, ["fund_b", "m"])
    found = both.groupBy("fund_a", "fund_b").agg(F.sum(F.least("_wa", "_wb")).alias("overlap"), F.count("*").alias("common"))
    return found.where(F.col("overlap") >= least) if least > 0 else found


def layer_accounting(fund_returns: DataFrame, market_return: DataFrame, candidates: DataFrame, overlaps: DataFrame, betas: DataFrame, twin: float = 0.9, alien: float = 0.05, fund: str = "fund") -> DataFrame:
    """fund return = market + sector + idio, idio as what is left.

    candidates: fund, sector_fund, sector_return; overlaps: fund, sector_fund, overlap. A candidate that overlaps more than
    `twin` is the fund itself, less than `alien` has nothing to do with it; of the others the one that overlaps most counts.
    betas: fund, beta_market, beta_sector. market_return: one row.
    """
    ok = candidates.join(overlaps, [fund, "sector_fund"]).where((F.col("overlap") <= twin) & (F.col("overlap") >= alien))
    best = ok.groupBy(fund).agg(F.max_by(F.struct("sector_fund", "sector_return"), F.struct("overlap", (-F.col("sector_fund")).alias("k"))).alias("_b"))
    out = fund_returns.join(F.broadcast(market_return)).join(betas, fund, "left").join(best, fund, "left")
    market = F.coalesce(F.col("beta_market") * F.col("market_return"), F.lit(0.0))
    sector = F.coalesce(F.col("beta_sector") * (F.col("_b.sector_return") - F.col("market_return")), F.lit(0.0))
    out = out.withColumn("market", market).withColumn("sector", sector).withColumn("sector_fund", F.col("_b.sector_fund"))
    return out.withColumn("idio", F.col("fund_return") - F.col("market") - F.col("sector")).drop("_b")


def idio_contributors(holdings: DataFrame, returns: DataFrame, layers: DataFrame, top: int, value: str = "r", volume: str = "volume", fund: str = "fund", member: str = "constituent", weight: str = "weight") -> DataFrame:
    """The top members of each fund by |weight x (own return - market - sector)|. Halted ones (volume 0) are counted in n_halted, not ranked."""
    j = holdings.join(returns.withColumnRenamed("symbol", member), member).join(layers.select(fund, "market", "sector"), fund)
    j = j.withColumn("halted", F.col(volume) == 0).withColumn("contribution", F.col(weight) * (F.col(value) - F.col("market") - F.col("sector")))
    whole = Window.partitionBy(fund)
    j = j.withColumn("n_halted", F.count_if("halted").over(whole)).withColumn("advancers", F.count_if(~F.col("halted") & (F.col(value) > 0)).over(whole)).withColumn("decliners", F.count_if(~F.col("halted") & (F.col(value) < 0)).over(whole))
    j = j.where(~F.col("halted") & F.col("contribution").isNotNull())
    rank = F.row_number().over(whole.orderBy(F.abs("contribution").desc(), member))
    return j.withColumn("rank", rank).where(F.col("rank") <= top).select(fund, member, "contribution", "rank", "n_halted", "advancers", "decliners")


def dominant_layer(layers: DataFrame, cols: Sequence[str] = ("market", "sector", "idio"), threshold: float = 0.5) -> DataFrame:
    """The layer with the largest |share| of the sum of sizes; MIXED if none has the threshold."""
    total = sum((F.abs(c) for c in cols), F.lit(0.0))
    pairs = F.array(*[F.struct((F.abs(c) / F.nullif(total, F.lit(0.0))).alias("share"), F.lit(c).alias("name")) for c in cols])
    best = F.array_max(pairs)
    return layers.withColumn("layer_share", best["share"]).withColumn("layer", F.when(best["share"] >= threshold, best["name"]).otherwise("MIXED"))


def premium_split(bars: DataFrame, fund: str = "fund", ts: str = "ts", price: str = "close", basket: str = "basket", coverage: str = "coverage", min_coverage: float = 0.6) -> DataFrame:
    """Per bar: fund_return = basket_return + premium_change, in logs; only bars whose basket covers enough weight."""
    w = Window.partitionBy(fund).orderBy(ts)
    ok = bars.where(F.col(coverage) >= min_coverage)
    ok = ok.withColumn("fund_return", F.log(F.col(price) / F.lag(price).over(w))).withColumn("basket_return", F.log(F.col(basket) / F.lag(basket).over(w)))
    return ok.withColumn("premium_change", F.col("fund_return") - F.col("basket_return"))


def sector_mode_weight(holdings: DataFrame, sectors: DataFrame, threshold: float = 0.5, fund: str = "fund", member: str = "constituent", weight: str = "weight") -> DataFrame:
    """Share of a fund's weight by sector, and whether it reaches the threshold."""
    j = holdings.join(sectors.withColumnRenamed("symbol", member), member)
    by = j.groupBy(fund, "sector").agg(F.sum(weight).alias("_w"))
    total = by.groupBy(fund).agg(F.sum("_w").alias("_t"))
    return by.join(total, fund).select(fund, "sector", (F.col("_w") / F.col("_t")).alias("share"), (F.col("_w") / F.col("_t") >= threshold).alias("dominant"))


def basket_path_join(fund_bars: DataFrame, member_bars: DataFrame, holdings: DataFrame, prev_close: DataFrame, fund: str = "fund", member: str = "constituent", ts: str = "ts") -> DataFrame:
    """Per fund and time: its close, the basket (sum of weight x close / previous close) and the weight it covers."""
    m = member_bars.withColumnRenamed("symbol", member).join(prev_close.withColumnRenamed("symbol", member), member).join(holdings, member)
    basket = m.groupBy(fund, ts).agg((F.sum(F.col("weight") * F.col("close") / F.col("prev_close")) / F.sum("weight")).alias("basket"), F.sum("weight").alias("coverage"))
    return fund_bars.join(basket, [fund, ts])


def nav_price_join(nav: DataFrame, prices: DataFrame, triggers: DataFrame, fund: str = "fund", day: str = "d") -> DataFrame:
    """Premium on the triggered fund-days, with the change on the fund's day before (of all its days)."""
    prev = F.lag("premium").over(Window.partitionBy(fund).orderBy(day))
    j = nav.join(prices, [fund, day]).withColumn("premium", F.col("close") / F.nullif(F.col("nav"), F.lit(0.0)) - 1).withColumn("premium_change", F.col("premium") - prev)
    return j.join(triggers.select(fund, day).distinct(), [fund, day], "left_semi")


def daily_trigger(holdings: DataFrame, returns: DataFrame, threshold: float, fund: str = "fund") -> DataFrame:
    """Funds whose proxy return is at least the threshold in size; the reason names the coverage."""
    p = weighted_proxy(holdings, returns, fund=fund)
    return p.where(F.abs("proxy") >= threshold).withColumn("reason", F.concat(F.lit("coverage="), F.format_number("coverage", 2)))


def grid_universe(holdings: DataFrame, bars: DataFrame, top: int, fund: str = "fund", member: str = "constituent", weight: str = "weight", day: str = "trade_date") -> DataFrame:
    """Cells: the top members by weight of any fund, on the days that they have bars."""
    rank = F.row_number().over(Window.partitionBy(fund).orderBy(F.desc(weight), member))
    names = holdings.withColumn("_k", rank).where(F.col("_k") <= top).select(F.col(member).alias("symbol")).distinct()
    return bars.select("symbol", day).distinct().join(names, "symbol", "left_semi")


def scope_cover(contributions: DataFrame, cover: float = 0.5, group: str = "fund", scope: str = "constituent", value: str = "contribution") -> DataFrame:
    """The fewest scopes of each group whose sizes make the share `cover` of all."""
    size = F.abs(value)
    w = Window.partitionBy(group).orderBy(size.desc(), scope)
    run = contributions.withColumn("_before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_all", F.sum(size).over(Window.partitionBy(group)))
    return run.where(F.col("_before") < cover * F.col("_all")).groupBy(group).agg(F.count("*").alias("n_scopes"), (F.sum(size) / F.first("_all")).alias("covered"))


def loo_layers(returns: DataFrame, labels: DataFrame, value: str = "r", key: str = "symbol", day: str = "trade_date", label: str = "sector") -> DataFrame:
    """Leave-one-out layers: market (mean of the others), cluster (the mean of the others of its label, less market), idio; they add up to the return."""
    j = returns.where(F.col(value).isNotNull()).join(labels, key)
    m = j.groupBy(day).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    c = j.groupBy(day, label).agg(F.sum(value).alias("_cs"), F.count("*").alias("_cn"))
    x = F.col(value)
    out = j.join(F.broadcast(m), day).join(c, [day, label]).withColumn("market", (F.col("_s") - x) / F.nullif(F.col("_n") - 1, F.lit(0)))
    out = out.withColumn("cluster", (F.col("_cs") - x) / F.nullif(F.col("_cn") - 1, F.lit(0)) - F.col("market"))
    return out.withColumn("idio", x - F.col("market") - F.col("cluster")).drop("_s", "_n", "_cs", "_cn")
