"""Event-study statistics over all event types and entities at once. "Random" draws are hashes of a seed and stable keys, so results don't depend on where rows are."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import date
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.exact import drawn_sums, quantiles
from marketlens.sources.sink import written

#: P(a Poisson(1) count is below k) for k from 1.
POISSON = np.cumsum(np.exp(-1) / np.concatenate(([1.0], np.cumprod(np.arange(1.0, 7.0))))).tolist()


def _key(key: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in key])


def _drawn(rows: DataFrame, draws: int, seed: int, per: int) -> DataFrame:
    """rows (with _key) for each draw _p, with _x: the 32 / per hex digits of MD5(seed|block|_key) that belong to the draw; per draws share a block. Any engine has this hash."""
    block = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // per)))).withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "_b", "_key")))
    each = block.withColumn("_p", F.explode(F.expr(f"sequence(_b * {per} + 1, least(_b * {per} + {per}, {draws}))")))
    return each.withColumn("_x", F.expr(f"substr(_h, ((_p - 1) % {per}) * {32 // per} + 1, {32 // per})")).drop("_b", "_h")


def event_panel(panel: DataFrame, events: DataFrame, event_type: str | None, day: date, key: str = "symbol", order: str = "trade_date", type_col: str = "event_type", *, today: bool = False) -> DataFrame:
    """Panel rows on days, before day (or on it), on which their entity has an event of the type."""
    e = events if event_type is None else events.where(F.col(type_col) == event_type)
    when = F.col(order) == F.lit(day) if today else F.col(order) < F.lit(day)
    return panel.where(when).join(e.select(key, order).distinct(), [key, order], "left_semi")


def series_panel(panel: DataFrame, z: str, threshold: float, day: date, order: str = "trade_date") -> DataFrame:
    """Panel rows before day on which |z| is at least the threshold."""
    return panel.where((F.col(order) < F.lit(day)) & (F.abs(z) >= threshold))


def dose_response(panel: DataFrame, exposure: str, y: str, cut: float = 0.8, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Per group: mean of y among rows whose exposure is in the top share (1 - cut) less that of the others. The bound is the exposure's exact percentile."""
    ok = panel.where(F.col(exposure).isNotNull() & F.col(y).isNotNull())
    bound = quantiles(ok, by, [("_q", exposure, cut)])
    high = F.col(exposure) > F.col("_q")
    g = ok.join(bound, list(by)).groupBy(*by).agg(F.count_if(high).alias("n_high"), F.count_if(~high).alias("n_low"), F.avg(F.when(high, F.col(y))).alias("_h"), F.avg(F.when(~high, F.col(y))).alias("_l"))
    return g.withColumn("effect", F.col("_h") - F.col("_l")).drop("_h", "_l")


def stratified_permutation(panel: DataFrame, label: str, y: str, stratum: str, key: Sequence[str], perms: int = 1000, seed: int = 7, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Per group: mean difference of y between label 1 and 0, and its two-sided p under shuffling labels within strata.

    Only rows of strata with both labels count. A draw orders each stratum's rows by a hash and labels the first ones, as
    many as are labelled. A draw's mean difference follows from the sum over those, and the whole.
    """
    ok = panel.where(F.col(label).isNotNull() & F.col(y).isNotNull()).select(*by, stratum, F.col(label).cast("int").alias("_d"), F.col(y).cast("double").alias("_y"), _key(key).alias("_key"))
    n = written(ok.groupBy(*by, stratum).agg(F.sum("_d").alias("_k"), F.count("*").alias("_n")).where("_k > 0 AND _k < _n"))
    rows = ok.join(n, [*by, stratum])
    real = rows.groupBy(*by).agg(F.sum("_d").alias("n_treated"), F.count("*").alias("n"), (F.avg(F.when(F.col("_d") == 1, F.col("_y"))) - F.avg(F.when(F.col("_d") == 0, F.col("_y")))).alias("effect"))
    whole = rows.groupBy(*by).agg(F.sum("_d").alias("_k"), F.count("*").alias("_n"), F.sum("_y").alias("_t"))
    one = drawn_sums(rows, by, stratum, perms, seed).join(whole, list(by)).withColumn("_e", F.col("_s") / F.col("_k") - (F.col("_t") - F.col("_s")) / (F.col("_n") - F.col("_k")))
    p = one.join(real.select(*by, "effect"), list(by)).groupBy(*by).agg(((F.count_if(F.abs("_e") >= F.abs("effect") - 1e-12) + 1) / (F.lit(perms) + 1)).alias("p_value"))
    return real.join(p, list(by), "left")


def edge_verdict(tests: DataFrame, min_n: int, alpha: float, n: str = "n", p: str = "p_value") -> DataFrame:
    """UNMEASURABLE below min_n or without a p, else HOLDS or FAILS at alpha over the number of measurable tests (Bonferroni)."""
    can = (F.col(n) >= min_n) & F.col(p).isNotNull()
    m = tests.agg(F.greatest(F.count_if(can), F.lit(1)).alias("m"))
    out = tests.join(F.broadcast(m))  # one row
    return out.withColumn("verdict", F.when(~can, "UNMEASURABLE").when(F.col(p) <= alpha / F.col("m"), "HOLDS").otherwise("FAILS"))


def interaction_effect(panel: DataFrame, d: str, c: str, y: str, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Per group: the coefficient of d x c in y ~ 1 + d + c + d x c. With both 0 or 1 it is a difference of four cell means."""
    cell = lambda i, j: F.avg(F.when((F.col(d) == i) & (F.col(c) == j), F.col(y)))
    return panel.where(F.col(y).isNotNull()).groupBy(*by).agg((cell(1, 1) - cell(1, 0) - cell(0, 1) + cell(0, 0)).alias("interaction"), F.count("*").alias("n"))


def running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the running sum of value by order (distinct values): sums within ranges of it, and those of the ranges before. No row meets all others."""
    ranged = df.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    cut = ranged.groupBy("_range").agg(F.min(order).alias("_low"), F.sum(value).alias("_sum"))
    # One row for each range. Ranges are named by their bounds, so it doesn't matter if they are cut anew.
    rows = sorted((r._low, r._sum) for r in cut.collect() if r._low is not None)
    bounds, upto = [r[0] for r in rows], np.concatenate(([0.0], np.cumsum([float(r[1] or 0) for r in rows])))[:-1].tolist()
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    kind = df.schema[order].dataType
    at = F.size(F.filter(F.lit(bounds).cast(f"array<{kind.simpleString()}>"), lambda b: b <= F.col(order)))
    own = df.withColumn("_range", at)
    w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.element_at(F.lit(upto), F.col("_range"))
    return own.withColumn(name, F.sum(value).over(w) + base).drop("_range")


def condition_today(panel: DataFrame, today: DataFrame, conditions: Sequence[str], cut: float = 0.8, key: str = "symbol") -> DataFrame:
    """Each condition of each key today: the share of the panel's values at or below it, and whether it reaches the cut.

    The panel's values are ranked once for each condition; today's join in their order, so no pairs are formed.
    """
    out = None
    for c in conditions:
        both = panel.select(F.lit(None).cast("string").alias("_k"), F.col(c).cast("double").alias("_v")).where("_v IS NOT NULL").unionByName(today.select(F.col(key).cast("string").alias("_k"), F.col(c).cast("double").alias("_v")).where("_v IS NOT NULL"))
        counts = both.groupBy("_v").agg(F.count_if(F.col("_k").isNull()).alias("_n"))  # a row for each value
        total = counts.agg(F.sum("_n").alias("_t"))
        below = running(counts, "_v", "_n", "_b").join(F.broadcast(total)).select("_v", (F.col("_b") / F.col("_t")).alias("pct"))
        one = today.select(key, F.lit(c).alias("condition"), F.col(c).cast("double").alias("_v")).join(below, "_v").drop("_v")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("active", F.col("pct") >= cut)


def sign_flip(pairs: DataFrame, diff: str, key: Sequence[str], perms: int, seed: int, by: Sequence[str]) -> DataFrame:
    """Per group: mean of paired differences, and its two-sided p under flipping pairs' signs (by hash)."""
    ok = pairs.where(F.col(diff).isNotNull()).select(*by, F.col(diff).alias("_y"), _key(key).alias("_key"))
    real = ok.groupBy(*by).agg(F.avg("_y").alias("att"), F.count("*").alias("n_pairs"))
    flip = F.when(F.col("_x") < "8", F.col("_y")).otherwise(-F.col("_y"))
    one = _drawn(ok, perms, seed, 32).groupBy(*by, "_p").agg(F.avg(flip).alias("_e"))
    p = one.join(real, list(by)).groupBy(*by).agg(((F.count_if(F.abs("_e") >= F.abs("att") - 1e-12) + 1) / (F.lit(perms) + 1)).alias("p_value"))
    return real.join(p, list(by))


def matched_att(pairs: DataFrame, covariates: Sequence[str], key: Sequence[str], y: str = "r", perms: int = 500, seed: int = 7, by: Sequence[str] = ("sector",)) -> DataFrame:
    """Per group: ATT on matched pairs (columns t_x, c_x), sign-flip p, and the largest standardised mean difference of the covariates."""
    att = sign_flip(pairs.withColumn("_diff", F.col(f"t_{y}") - F.col(f"c_{y}")), "_diff", key, perms, seed, by)
    smd = [F.abs(F.avg(f"t_{c}") - F.avg(f"c_{c}")) / F.nullif(F.sqrt((F.var_samp(f"t_{c}") + F.var_samp(f"c_{c}")) / 2), F.lit(0.0)) for c in covariates]
    balance = pairs.groupBy(*by).agg((F.greatest(*smd) if len(smd) > 1 else smd[0]).alias("max_smd"))
    return att.join(balance, list(by))


def multi_att(pairs: DataFrame, flags: Sequence[str], diff: str, key: Sequence[str] | None = None, perms: int = 1000, seed: int = 7, solo: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """flag, att, p_value, n, n_treated, solo_att, solo_p, solo_n: coefficients of the pair difference on 0/1 treatment flags, all at once, beside each treatment alone.

    p_value is two-sided, under flipping the signs of whole pairs (by hash of key, all columns unless named): each draw is
    fitted on all flags anew. What a treatment takes from the others when it is tried alone shows in solo_att, the mean
    difference (and sign-flip p) of the pairs of its own trial: solo's, else those of pairs that have its flag. Sums are
    made in Spark, a row a draw; what is solved is a matrix of the flags' number.
    """
    key, k = list(key or pairs.columns), len(flags)
    ok = pairs.where(F.col(diff).isNotNull()).select(*[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(flags)], F.col(diff).cast("double").alias("_y"), _key(key).alias("_key"))
    row = ok.agg(F.count("*").alias("n"), *[F.sum(F.col(f"_f{i}") * F.col(f"_f{j}")).alias(f"g_{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(F.col(f"_f{i}") * F.col("_y")).alias(f"b_{i}") for i in range(k)], *[F.count_if(F.col(f"_f{i}") != 0).alias(f"n_{i}") for i in range(k)]).first()
    inverse = np.linalg.pinv(np.array([[float(row[f"g_{i}_{j}"] or 0) for j in range(k)] for i in range(k)]))
    beta = inverse @ np.array([float(row[f"b_{i}"] or 0) for i in range(k)])
    flip = F.when(F.col("_x") < "8", F.col("_y")).otherwise(-F.col("_y"))
    drawn = _drawn(ok, perms, seed, 32).groupBy("_p").agg(*[F.sum(F.col(f"_f{i}") * flip).alias(f"_b{i}") for i in range(k)])
    null = [sum((F.lit(float(inverse[i, j])) * F.col(f"_b{j}") for j in range(1, k)), F.lit(float(inverse[i, 0])) * F.col("_b0")) for i in range(k)]
    hits = drawn.agg(*[F.count_if(F.abs(e) >= abs(float(beta[i])) - 1e-12).alias(f"h_{i}") for i, e in enumerate(null)]).first()
    told = pairs.sparkSession.createDataFrame([(f, float(beta[i]), (hits[f"h_{i}"] + 1) / (perms + 1) if row.n else None, int(row.n), int(row[f"n_{i}"])) for i, f in enumerate(flags)], "flag string, att double, p_value double, n long, n_treated long")
    alone = None
    for f in flags:
        own = solo[f] if solo else pairs.where(F.col(f) != 0)
        own = own.select(F.lit(f).alias("flag"), F.col(diff).cast("double").alias("_diff"), *key)
        alone = own if alone is None else alone.unionByName(own)
    each = sign_flip(alone, "_diff", key, perms, seed, ["flag"]).select("flag", F.col("att").alias("solo_att"), F.col("p_value").alias("solo_p"), F.col("n_pairs").alias("solo_n"))
    return told.join(each, "flag", "left").withColumn("solo_n", F.coalesce("solo_n", F.lit(0).cast("long")))


def market_day_att(series: DataFrame, event_days: DataFrame, vol_caliper: float, trend_caliper: float, k: int, order: str = "trade_date") -> DataFrame:
    """Days as units: each event day's return less the mean of its k nearest clean days of the same weekday, by log volatility and trend. A series has a row a day."""
    s = series.withColumn("dow", F.dayofweek(order))
    hit = event_days.select(order).distinct()
    t = s.join(hit, order, "left_semi").select("dow", F.col(order).alias("t_day"), F.col("r").alias("t_r"), F.col("ln_vol").alias("t_v"), F.col("trend").alias("t_t"))
    c = s.join(hit, order, "left_anti").select("dow", F.col(order).alias("c_day"), F.col("r").alias("c_r"), F.col("ln_vol").alias("c_v"), F.col("trend").alias("c_t"))
    dv, dt_ = F.abs(F.col("t_v") - F.col("c_v")), F.abs(F.col("t_t") - F.col("c_t"))
    m = t.join(c, "dow").where((dv <= vol_caliper) & (dt_ <= trend_caliper)).withColumn("_d", dv / vol_caliper + dt_ / trend_caliper)
    m = m.withColumn("_n", F.row_number().over(Window.partitionBy("t_day").orderBy("_d", "c_day"))).where(F.col("_n") <= k)
    return m.groupBy("t_day").agg((F.first("t_r") - F.avg("c_r")).alias("effect"), F.count("*").alias("n_controls"))


def moderator_panel(pairs: DataFrame, moderators: Sequence[str], max_missing: float = 0.2) -> tuple[DataFrame, list[str]]:
    """Complete rows with moderators as percentile ranks; those missing too often are dropped, with the reason."""
    rates = pairs.agg(*[F.avg(F.col(m).isNull().cast("int")).alias(m) for m in moderators]).first()
    kept = [m for m in moderators if (rates[m] or 0) <= max_missing]
    out = pairs.dropna(subset=kept) if kept else pairs
    for m in kept:
        counts = out.groupBy(m).agg(F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n").alias("_t"))
        ranks = running(counts, m, "_n", "_b").withColumn("_b", F.col("_b") - F.col("_n")).join(F.broadcast(total)).select(m, (F.col("_b") / F.nullif(F.col("_t") - 1, F.lit(0))).alias(f"{m}_pct"))
        out = out.join(ranks, m)
    return out, [f"{m}: {rates[m]:.0%} missing" for m in moderators if m not in kept]


def rank_with_ties(draws: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Names by mean, with 95 % intervals of their draws; a name whose interval overlaps that of the first of the current rank shares it.

    Which name begins a rank follows from the one before. So names are cut into ranges by mean, and the ranges are walked in
    order, each in a task of its own: a range takes the rank, and the lower bound that begins it, from the one before.
    """
    q = quantiles(draws, [name], [("low", value, 0.025), ("high", value, 0.975)])
    g = draws.groupBy(name).agg(F.avg(value).alias("mean")).join(q, name).select(F.col(name).cast("string").alias("name"), "mean", "low", "high")
    order = [F.desc("mean"), F.col("name")]
    ranged = written(g.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    schema, out, before, rank, head = "name string, rank int, mean double, low double, high double", None, 0, 0, None
    for r in sorted(ranged.groupBy("_range").count().collect()):  # one row a range

        def walk(batches: Iterator[pa.RecordBatch], before: int = before, rank: int = rank, head: float | None = head) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ranks = []
                for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                    before += 1
                    if head is None or high < head:
                        rank, head = before, low
                    ranks.append(rank)
                yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(ranks, pa.int32()), *(batch.column(c) for c in ("mean", "low", "high"))], names=["name", "rank", "mean", "low", "high"])

        own = written(ranged.where(F.col("_range") == r["_range"]).drop("_range").coalesce(1).sortWithinPartitions(*order).mapInArrow(walk, schema))
        last = own.orderBy(F.desc("rank"), *order).first()  # the first name of the last rank that began, or one that shares an earlier one
        if rank != last.rank:
            rank, head = last.rank, last.low
        before += r["count"]
        out = own if out is None else out.unionByName(own)
    return g.sparkSession.createDataFrame([], schema) if out is None else out


def stability_split(panel: DataFrame, exposure: str, y: str, order: str = "trade_date", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """dose_response() in the halves before and after each group's median date, and whether they agree in sign."""
    mid = quantiles(panel.withColumn("_day", F.unix_date(order)), by, [("_m", "_day", 0.5)])
    half = panel.join(mid, list(by)).withColumn("half", F.when(F.unix_date(order) <= F.col("_m"), 1).otherwise(2))
    d = dose_response(half, exposure, y, by=[*by, "half"])
    g = d.groupBy(*by).agg(F.max(F.when(F.col("half") == 1, F.col("effect"))).alias("first"), F.max(F.when(F.col("half") == 2, F.col("effect"))).alias("second"))
    return g.withColumn("same_sign", F.signum("first") == F.signum("second"))


def additive_budget(claims: DataFrame, budget: DataFrame, sigma: DataFrame, key: str = "symbol") -> DataFrame:
    """Whether the sum of |att| stays within |budget| + 1.96 sigma; NOT_COMPUTED without a sigma."""
    s = claims.groupBy(key).agg(F.sum(F.abs("att")).alias("claimed"))
    j = s.join(budget, key).join(sigma, key, "left")
    return j.withColumn("verdict", F.when(F.col("sigma").isNull(), "NOT_COMPUTED").when(F.col("claimed") <= F.abs("budget") + 1.96 * F.col("sigma"), "WITHIN").otherwise("EXCEEDS"))


def idio_budget(panel: DataFrame, market: DataFrame, day: date, order: str = "trade_date") -> DataFrame:
    """Each entity's residual and the market's mean of a day."""
    return panel.where(F.col(order) == F.lit(day)).join(F.broadcast(market.where(F.col(order) == F.lit(day)).select(F.col("market_mean"))))  # one row


def slope_ci(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Slope of y on x per group with its 95 % interval (normal), from sums alone."""
    g = df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    se = F.sqrt(F.greatest(F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"), F.lit(0.0)) / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif(F.col("_sxx"), F.lit(0.0)))
    return g.withColumn("se", se).withColumn("low", F.col("slope") - 1.96 * se).withColumn("high", F.col("slope") + 1.96 * se).drop("_sxx", "_syy")


def identification_route(gates: DataFrame, point: str = "point", bounds: str = "bounds", exclusion: str = "exclusion") -> DataFrame:
    return gates.withColumn("route", F.when(F.col(point), "POINT").when(F.col(bounds), "INTERVAL").when(F.col(exclusion), "EXCLUSION_ONLY").otherwise("REJECT"))


def _forest(d: np.ndarray, rank: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a minimum spanning forest of rows and columns at distances d (inf: none), by Prim's steps; same: rows are the columns. Of equal edges that of the least ends by rank goes first."""
    p, total = len(d), len(rank)
    best, code, via = np.full(total, np.inf), np.zeros(total, np.int64), np.zeros(total, np.int64)
    left = np.ones(total, bool)
    one, two, at = [], [], 0
    while True:
        left[at], best[at] = False, np.inf
        if same:
            far = d[at]
        else:
            far = np.full(total, np.inf)
            far[p:], far[:p] = (d[at], np.inf) if at < p else (np.inf, d[:, at - p])
        own = np.minimum(rank[at], rank) * total + np.maximum(rank[at], rank)
        nearer = left & ((far < best) | ((far == best) & (far < np.inf) & (own < code)))
        best[nearer], code[nearer], via[nearer] = far[nearer], own[nearer], at
        least = best.min()
        if least == np.inf:
            rest = np.flatnonzero(left)
            if not len(rest):
                return np.array(one, np.int64), np.array(two, np.int64)
            at = int(rest[0])
            continue
        ties = np.flatnonzero(best == least)
        at = int(ties[np.argmin(code[ties])])
        one.append(via[at])
        two.append(at)


#: Parts that keys go in at most: each key is sent once for each, so what is sent grows as the keys do. Within two parts a task goes by blocks.
PARTS = 16


def _thinned(i: np.ndarray, j: np.ndarray, d: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the edges i, j at distances d a minimum spanning forest has, by Boruvka's rounds. Of equal edges that of the least ends by rank goes first."""
    order = np.lexsort((np.maximum(rank[i], rank[j]), np.minimum(rank[i], rank[j]), d))
    label, kept = np.arange(len(rank)), []
    while len(order):
        x, y = label[i[order]], label[j[order]]
        left = x != y
        order, x, y = order[left], x[left], y[left]
        if not len(order):
            break
        at = np.arange(len(order))
        first = np.full(len(rank), -1)
        ends = np.stack([x, y], 1).ravel()[::-1]
        first[ends] = np.repeat(at, 2)[::-1]  # the last one written is the least
        own = np.flatnonzero(first >= 0)
        up = np.arange(len(rank))
        up[own] = x[first[own]] + y[first[own]] - own
        twin = own[(up[up[own]] == own) & (own < up[own])]
        up[twin] = twin
        kept.append(order[np.unique(first[own])])
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _levels(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
    """(t, label): what hangs together by a forest's edges of at most t, for some t. Any other edge longer than t within a label is in no forest."""
    out = []
    for t in np.unique(np.quantile(d, [0.5, 0.9, 0.99, 1.0], method="lower")) if len(d) else ():
        label, near = np.arange(n), d <= t
        x, y = i[near], j[near]
        while True:
            low = np.minimum(label[x], label[y])
            now = label.copy()
            np.minimum.at(now, label[x], low)
            np.minimum.at(now, label[y], low)
            while (now[now] != now).any():
                now = now[now]
            now = now[label]
            if (now == label).all():
                break
            label = now
        out.append((float(t), label))
    return out


def _correlations(returns: DataFrame, min_days: int, key: str, order: str, value: str, block: int, spanning: bool) -> DataFrame:
    kind, day = returns.schema[key].dataType, returns.schema[order].dataType.typeName()
    number = F.unix_date(order) if day == "date" else F.col(order) if day in ("byte", "short", "integer", "long") else F.col(order).cast("string")
    ok = returns.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), number.alias("d"), F.col(value).cast("double").alias("v"))
    rows = written(ok.groupBy("k").agg(F.collect_list("d").alias("ds"), F.collect_list("v").alias("vs")))
    parts = min(-(-rows.count() // block) or 1, PARTS)
    own = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(pair: tuple[Any, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(list(batches)).combine_chunks()
        whole = lambda c: g.column(c).combine_chunks()
        keys, ds, vs = whole("k"), whole("ds"), whole("vs")
        sizes = ds.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        days, col = np.unique(ds.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        flat, line = vs.flatten().to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(sizes)), sizes)
        flat = flat - (np.bincount(line, flat, len(sizes)) / sizes)[line]
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(keys))
        lo, alike = whole("own").to_numpy() == pair[0].as_py(), pair[0] == pair[1]
        one = np.flatnonzero(lo)
        cut = lambda at: [at[k : k + block] for k in range(0, len(at), block)]
        ones, twos = cut(one), cut(one if alike else np.flatnonzero(~lo))

        def matrix(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = np.repeat(np.arange(len(at)), sizes[at])
            place = np.arange(len(row)) + np.repeat(ends[at] - np.cumsum(sizes[at]), sizes[at])
            x, m = np.zeros((len(at), len(days))), np.zeros((len(at), len(days)))
            x[row, col[place]], m[row, col[place]] = flat[place], 1.0
            return x, m

        def told(i: np.ndarray, j: np.ndarray, rho: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            first = rank[i] < rank[j]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(np.where(first, i, j))), keys.take(pa.array(np.where(first, j, i))), pa.array(rho), pa.array(n.astype(np.int64))], names=["a", "b", "rho", "n"])

        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]  # i, j, rho, n of the forest so far
        mate, common, levels = np.full(len(keys), -1), np.zeros(len(keys)), []
        # The first row and column of blocks go first: what they join tells what is too long elsewhere.
        todo = sorted(((p, q) for p in range(len(ones)) for q in range(p if alike else 0, len(twos))), key=lambda t: (min(t), t))
        last = None
        for p, q in todo:
            i0, j0, same = ones[p], twos[q], alike and p == q
            if last is None or last[0] != p:
                last = (p, *matrix(i0))
            (xa, ma), (xb, mb) = last[1:], last[1:] if same else matrix(j0)
            with np.errstate(divide="ignore", invalid="ignore"):
                if ma.all() and mb.all():
                    n = np.broadcast_to(float(len(days)), (len(i0), len(j0)))
                    sx, sy, xx, yy = xa.sum(1)[:, None], xb.sum(1)[None, :], (xa * xa).sum(1)[:, None], (xb * xb).sum(1)[None, :]
                    vx, vy = xx - sx * sx / len(days), yy - sy * sy / len(days)
                else:
                    n = ma @ mb.T
                    sx, sy, xx, yy = xa @ mb.T, ma @ xb.T, (xa * xa) @ mb.T, ma @ (xb * xb).T
                    vx, vy = xx - sx * sx / n, yy - sy * sy / n
                rho = np.where((vx > 1e-12 * xx) & (vy > 1e-12 * yy), (xa @ xb.T - sx * sy / n) / np.sqrt(vx * vy), np.nan)
            often = n >= min_days
            if same:
                np.fill_diagonal(often, False)
            if not spanning:
                i, j = np.nonzero(often & (rank[i0][:, None] < rank[j0][None, :]) if same else often)
                yield told(i0[i], j0[j], rho[i, j], n[i, j])
                continue
            far = np.where(often & ~np.isnan(rho), 1 - rho, np.inf)
            # Keys of no edge: a pair without a rho tells that they are there.
            for a, ids, mates in ((often, i0, j0), (often.T, j0, i0)):
                alone = np.flatnonzero(a.any(axis=1) & (mate[ids] < 0))
                other = a[alone].argmax(axis=1)
                mate[ids[alone]] = mates[other]
                common[ids[alone]] = (n if a is often else n.T)[alone, other]
            short = far < np.inf
            for t, label in levels:
                short &= (far <= t) | (label[i0][:, None] != label[j0][None, :])
            if same:
                short = np.triu(short)
            if levels and np.count_nonzero(short) <= 16 * block:
                i, j = np.nonzero(short)
            else:
                at = i0 if same else np.concatenate([i0, j0])
                near = np.empty(len(at), np.int64)
                near[np.argsort(rank[at])] = np.arange(len(at))
                i, j = _forest(far, near, same)
                if not same:
                    i, j = np.minimum(i, j), np.maximum(i, j) - len(i0)
            held = [np.concatenate(c) for c in zip(held, (i0[i], j0[j], rho[i, j], n[i, j]), strict=True)]
            if len(held[0]) > 4 * len(keys) or (p, q) == todo[-1] or not levels and min(p, q) > 0:
                keep = _thinned(held[0], held[1], 1 - held[2], rank)
                held = [c[keep] for c in held]
                levels = _levels(held[0], held[1], 1 - held[2], len(keys)) if (p, q) != todo[-1] else levels
        if spanning:
            yield told(*held)
            mate[held[0]] = mate[held[1]] = -1
            rest = np.flatnonzero(mate >= 0)
            yield told(rest, mate[rest], np.full(len(rest), np.nan), common[rest])

    dealt = own.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "k", "ds", "vs")
    out = dealt.groupBy("lo", "hi").applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}, rho double, n long")
    return out.withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))


def return_correlation(returns: DataFrame, min_days: int, key: str = "symbol", order: str = "trade_date", value: str = "r", block: int = 512) -> DataFrame:
    """a, b, rho, n: correlations of keys a < b over their common days, at least min_days; null where a side doesn't vary.

    Keys go in PARTS at most; a task takes two of them, and multiplies the key-by-day matrices of `block` keys each at a time,
    so no rows are paired by day. A key has one value a day.
    """
    return _correlations(returns, min_days, key, order, value, block, False)


def spanning_correlations(returns: DataFrame, min_days: int, key: str = "symbol", order: str = "trade_date", value: str = "r", block: int = 1024) -> DataFrame:
    """Those rows of return_correlation() that a minimum spanning forest by 1 - rho can hold, and at least one of each key that has any.

    Of two parts only their own forest is kept, fewer rows than they have keys: an edge that isn't in it is the longest of
    a circle, so it is in no forest of the whole either.
    """
    return _correlations(returns, min_days, key, order, value, block, True)


def cluster_stability(a: DataFrame, b: DataFrame, key: str = "symbol", label: str = "label") -> DataFrame:
    """One row: the adjusted Rand index of two labellings of the keys that both have, from contingency counts."""
    j = a.select(key, F.col(label).alias("_a")).join(b.select(key, F.col(label).alias("_b")), key)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cell = j.groupBy("_a", "_b").agg(F.count("*").alias("_n")).agg(pairs("_n").alias("_ab"))
    ra = j.groupBy("_a").agg(F.count("*").alias("_n")).agg(pairs("_n").alias("_sa"))
    rb = j.groupBy("_b").agg(F.count("*").alias("_n")).agg(pairs("_n").alias("_sb"))
    n = j.agg(F.count("*").alias("n"))
    one = cell.join(ra).join(rb).join(n)  # a row each
    expected = F.col("_sa") * F.col("_sb") / F.nullif(F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0))
    return one.select("n", ((F.col("_ab") - expected) / F.nullif((F.col("_sa") + F.col("_sb")) / 2 - expected, F.lit(0.0))).alias("ari"))


def layer_diagnostics(layers: DataFrame, key: str = "symbol", order: str = "trade_date", value: str = "r") -> DataFrame:
    """Per name: slope on the market layer, share of variance of market and cluster, correlation between them, lag-1 autocorrelation of the idiosyncratic one."""
    j = layers.withColumn("_lag", F.lag("idio").over(Window.partitionBy(key).orderBy(order)))
    v = F.nullif(F.var_pop(value), F.lit(0.0))
    return j.groupBy(key).agg(F.regr_slope(value, "market").alias("beta"), (F.var_pop("market") / v).alias("market_share"), (F.var_pop("cluster") / v).alias("cluster_share"), F.corr("market", "cluster").alias("layer_corr"), F.corr("idio", "_lag").alias("autocorr"))


def beta_cap_vs_equal(returns: DataFrame, weights: DataFrame, key: str = "symbol", order: str = "trade_date", value: str = "r") -> DataFrame:
    """Per name: slope on the cap-weighted and on the equal-weight market of each day."""
    j = returns.where(F.col(value).isNotNull()).join(weights, key)
    m = j.groupBy(order).agg(F.avg(value).alias("_eq"), (F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("_cap"))
    return j.join(m, order).groupBy(key).agg(F.regr_slope(value, "_cap").alias("beta_cap"), F.regr_slope(value, "_eq").alias("beta_equal"), F.count("*").alias("n"))


def spike_alignment(returns: DataFrame, counts: DataFrame, q: float = 0.8, extreme: float = 0.9, key: str = "symbol", order: str = "trade_date", value: str = "idio") -> DataFrame:
    """Per name: share of days with a spike of counts (over its own percentile) on its extreme days over that on the others."""
    j = returns.join(counts, [key, order], "left").fillna(0, ["n_articles"])
    bound = j.groupBy(key).agg(F.percentile("n_articles", F.lit(q)).alias("_q"), F.percentile(F.abs(value), F.lit(extreme)).alias("_x"))
    j = j.join(bound, key).withColumn("_s", (F.col("n_articles") > F.col("_q")).cast("int")).withColumn("_e", F.abs(value) >= F.col("_x"))
    return j.groupBy(key).agg(F.avg(F.when(F.col("_e"), F.col("_s"))).alias("spike_extreme"), F.avg(F.when(~F.col("_e"), F.col("_s"))).alias("spike_ordinary"))


def bootstrap_diff(daily: DataFrame, a: str, b: str, draws: int = 1000, seed: int = 7, key: str = "trade_date") -> DataFrame:
    """One row: mean of a - b, and its two-sided p by a Poisson bootstrap: each draw weighs days by hashes turned into Poisson(1) counts."""
    ok = daily.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("_d"), _key([key]).alias("_key"))
    u = F.conv("_x", 16, 10).cast("double") / 2**32
    weight: Column = F.lit(0)
    for s in POISSON:
        weight = weight + F.when(u >= s, 1).otherwise(0)
    real = ok.agg(F.avg("_d").alias("diff"), F.count("*").alias("n"))
    one = _drawn(ok, draws, seed, 4).withColumn("_w", weight).groupBy("_p").agg((F.sum(F.col("_w") * F.col("_d")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    j = one.join(F.broadcast(real))  # one row
    return j.groupBy("diff", "n").agg(F.least(F.lit(1.0), 2 * (F.least(F.count_if(F.col("_m") <= 0), F.count_if(F.col("_m") >= 0)) + 1) / (F.lit(draws) + 1)).alias("p_value"))


def _local_level(y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """q, h of each row of y, series of one length, after so many rounds of EM: a filter forwards, a smoother backwards, and the moments."""
    m, n = y.shape
    if n <= 2:
        return np.full(m, np.nan), np.full(m, np.nan)
    q = np.maximum(np.var(np.diff(y, axis=1), axis=1) / 2, 1e-10)
    h = q.copy()
    for _ in range(rounds):
        a, p, f = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m))
        at, pt = y[:, 0], h
        for t in range(n):
            f[t] = pt + q if t else pt
            gain = f[t] / (f[t] + h)
            a[t], p[t] = at + gain * (y[:, t] - at), (1 - gain) * f[t]
            at, pt = a[t], p[t]
        s, v, c = a.copy(), p.copy(), np.zeros((n, m))
        for t in range(n - 2, -1, -1):
            j = p[t] / f[t + 1]
            s[t], v[t] = a[t] + j * (s[t + 1] - a[t]), p[t] + j * j * (v[t + 1] - f[t + 1])
            c[t + 1] = j * v[t + 1]
        q = np.maximum(np.mean((s[1:] - s[:-1]) ** 2 + v[1:] + v[:-1] - 2 * c[1:], axis=0), 1e-12)
        h = np.maximum(np.mean((y.T - s) ** 2 + v, axis=0), 1e-12)
    return q, h


def local_level_em(bars: DataFrame, rounds: int = 20, key: str = "symbol", day: str = "trade_date", ts: str = "ts", price: str = "close") -> DataFrame:
    """Per symbol and day: variances (q of the level, h of the noise) of a local-level model of log prices, by EM. A day has a bounded number of bars; those without a positive price don't count.

    A task fits all series of one length in its batch at once.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series = batch.column("_y")
            n = np.asarray(series.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            flat, ends = np.log(series.flatten().to_numpy(zero_copy_only=False).astype(float)), np.cumsum(n)
            q, h = np.empty(len(n)), np.empty(len(n))
            for size in np.unique(n):
                own = np.flatnonzero(n == size)
                q[own], h[own] = _local_level(flat[(ends[own] - size)[:, None] + np.arange(size)], rounds)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(day), pa.array(q), pa.array(h), pa.array(n)], names=[key, day, "q", "h", "n"])

    kind = dict(bars.dtypes)
    rows = bars.where(F.col(price) > 0).groupBy(key, day).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(price).cast("double").alias("c")))).getField("c").alias("_y"))
    return rows.mapInArrow(fit, f"{key} {kind[key]}, {day} {kind[day]}, q double, h double, n long")
