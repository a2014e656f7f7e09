"""Explaining one day's moves: gaps and their covariates, gated trials, moderators, and the facts of a window."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.sink import written

from .bars import gap_return, window_return
from .events import PARTS, first_links
from .exact import drawn_sums, quantiles, weighted_quantile
from .stats import matched_att, slope_ci, stratified_permutation


def gap_series(bars: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Per day: log of the first open over the last close of the day before; days without one before are left out."""
    return gap_return(bars, key, ts).where(F.col("gap").isNotNull()).select(key, "trade_date", "gap")


def _last_session(days: DataFrame, factors: DataFrame, sector: str, day: str, take: Sequence[str]) -> DataFrame:
    """days with what take names of their sector's last session before the day. Both sides go to their sector's days, a session's columns are carried forward."""
    struct = F.struct(*take)
    own = days.select(sector, day).distinct().withColumn("_x", F.lit(None).cast(factors.select(struct.alias("x")).schema["x"].dataType))
    both = own.unionByName(factors.select(F.col(sector), F.col("session").alias(day), struct.alias("_x")))
    # A session on the day itself isn't before it: rows of days come first among equals.
    w = Window.partitionBy(sector).orderBy(day, F.col("_x").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_l", F.last("_x", ignorenulls=True).over(w)).where("_x IS NULL").select(sector, day, "_l")
    return days.join(found, [sector, day], "left").select(*days.columns, *[F.col(f"_l.{c}").alias(c) for c in take])


def gap_covariate(gaps: DataFrame, sectors: DataFrame, factors: DataFrame, day: date, min_n: int = 30, key: str = "symbol") -> DataFrame:
    """Per key with a gap on the day: what its sector's overnight factor may explain of it, as an interval.

    gaps: key, trade_date, gap. sectors: key, sector. factors: sector, session, factor_return. The slope's 95 % interval on
    the days before, times the factor's return in the last session before the day, is cut to lie between 0 and the gap
    (explained_low, explained_high). If nothing is left the factor is opposed. reason says what is missing, if anything.
    """
    held = factors.where(F.col("factor_return").isNotNull()).select("sector", "session", "factor_return")
    rows = gaps.where(F.col("gap").isNotNull() & (F.col("trade_date") <= F.lit(day))).join(sectors.select(key, "sector"), key)
    rows = _last_session(rows, held, "sector", "trade_date", ["factor_return"])
    slope = slope_ci(rows.where(F.col("trade_date") < F.lit(day)).where(F.col("factor_return").isNotNull()), "factor_return", "gap", [key]).select(key, "n", "low", "high")
    own = rows.where(F.col("trade_date") == F.lit(day)).join(slope, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    one, two = F.col("low") * F.col("factor_return"), F.col("high") * F.col("factor_return")
    low = F.greatest(F.least(one, two), F.least(F.col("gap"), F.lit(0.0)))
    high = F.least(F.greatest(one, two), F.greatest(F.col("gap"), F.lit(0.0)))
    reason = F.when(F.col("factor_return").isNull(), "no session before").when(F.col("n") < min_n, "too few days").when(F.col("low").isNull(), "no variance")
    ok = reason.isNull() & (low <= high)
    return own.select(
        key, "sector", "gap", "factor_return", "n", F.when(reason.isNull(), F.col("low")).alias("beta_low"), F.when(reason.isNull(), F.col("high")).alias("beta_high"), F.when(ok, low).alias("explained_low"), F.when(ok, high).alias("explained_high"), (reason.isNull() & ~ok).alias("opposed"), reason.alias("reason")
    )


def market_reduction(gaps: DataFrame, covariates: DataFrame, day: date, top: int = 4, key: str = "symbol") -> DataFrame:
    """What a day's common move reduces to, as rows (kind, name, low, high): the largest overnight movers, each factor's return, and the range of gaps that each factor explains."""
    largest = gaps.where((F.col("trade_date") == F.lit(day)) & F.col("gap").isNotNull()).orderBy(F.abs("gap").desc(), key).limit(top)
    movers = largest.select(F.lit("overnight").alias("kind"), F.col(key).cast("string").alias("name"), F.col("gap").alias("low"), F.col("gap").alias("high"))
    by = covariates.groupBy("sector").agg(F.min("factor_return").alias("f"), F.min("explained_low").alias("low"), F.max("explained_high").alias("high"))
    factors = by.where("f IS NOT NULL").select(F.lit("factor").alias("kind"), F.col("sector").alias("name"), F.col("f").alias("low"), F.col("f").alias("high"))
    ranges = by.where("low IS NOT NULL").select(F.lit("gap range").alias("kind"), F.col("sector").alias("name"), "low", "high")
    return movers.union(factors).union(ranges)


def market_screen(series: DataFrame, events: DataFrame, prefixes: Sequence[str], min_days: int, top: int, vol_caliper: float, trend_caliper: float, k: int, alpha: float = 0.05, order: str = "trade_date", type_col: str = "event_type") -> DataFrame:
    """Market-wide event types (those with one of the prefixes) by their days: each one's mean effect over event days less clean days of the same weekday, all types at once.

    series has a row a day (r, ln_vol, trend), as for market_day_att; events: a row for each type and day. threshold is
    alpha over the number of types tried. z is the mean effect over its standard error.
    """
    wide = events.where(F.greatest(*[F.col(type_col).startswith(p) for p in prefixes]) if len(prefixes) > 1 else F.col(type_col).startswith(prefixes[0]))
    hit = wide.select(type_col, order).distinct().join(series.select(order), order, "left_semi")
    often = hit.groupBy(type_col).agg(F.count("*").alias("n_days")).where(F.col("n_days") >= min_days).orderBy(F.desc("n_days"), type_col).limit(top)
    s = series.withColumn("dow", F.dayofweek(order))
    t = hit.join(F.broadcast(often), type_col).join(s, order).select(type_col, "n_days", "dow", F.col(order).alias("t_day"), F.col("r").alias("t_r"), F.col("ln_vol").alias("t_v"), F.col("trend").alias("t_t"))
    c = s.select("dow", F.col(order).alias("c_day"), F.col("r").alias("c_r"), F.col("ln_vol").alias("c_v"), F.col("trend").alias("c_t"))
    dv, dt_ = F.abs(F.col("t_v") - F.col("c_v")), F.abs(F.col("t_t") - F.col("c_t"))
    pairs = t.join(c, "dow").where((dv <= vol_caliper) & (dt_ <= trend_caliper)).withColumn("_d", dv / vol_caliper + dt_ / trend_caliper)
    clean = pairs.join(hit.select(type_col, F.col(order).alias("c_day")), [type_col, "c_day"], "left_anti")
    near = clean.withColumn("_n", F.row_number().over(Window.partitionBy(type_col, "t_day").orderBy("_d", "c_day"))).where(F.col("_n") <= k)
    day = near.groupBy(type_col, "n_days", "t_day").agg((F.first("t_r") - F.avg("c_r")).alias("effect"))
    out = day.groupBy(type_col, "n_days").agg(F.count("*").alias("n_matched"), F.avg("effect").alias("effect"), (F.avg("effect") / F.nullif(F.stddev_samp("effect") / F.sqrt(F.count("*")), F.lit(0.0))).alias("z"))
    return out.withColumn("threshold", F.lit(alpha) / F.greatest(F.count("*").over(Window.partitionBy()), F.lit(1)))  # at most top rows


def relation_test(panel: DataFrame, y: str, conditions: Sequence[tuple[str, str, float]] = (), min_n: int = 30, perms: int = 1000, alpha: float = 0.05, stratum: str = "d", key: Sequence[str] = ("x", "y", "d"), by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Per group of a relation panel (linked: whether the row's instrument is related to the event's): mean reaction of related and of others, p under shuffling within dates, verdict.

    conditions: (column, ">=" or "<=", share): on the right side of the column's percentile in its group; all must hold.
    Groups with fewer than min_n rows, or fewer than three on either side, are UNMEASURABLE.
    """
    rows = panel.where(F.col(y).isNotNull())
    if conditions:
        bounds = quantiles(rows, by, [(f"_b{k}", c, share) for k, (c, _, share) in enumerate(conditions)])
        rows = rows.join(bounds, list(by))
    for k, (c, how, _) in enumerate(conditions):
        rows = rows.where(F.col(c) >= F.col(f"_b{k}") if how == ">=" else F.col(c) <= F.col(f"_b{k}"))
    rows = rows.withColumn("_l", F.col("linked").cast("int"))
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_l").alias("n_linked"), F.avg(F.when(F.col("linked"), F.col(y))).alias("linked_mean"), F.avg(F.when(~F.col("linked"), F.col(y))).alias("other_mean"))
    tests = stratified_permutation(rows, "_l", y, stratum, key, perms=perms, by=by).select(*by, "p_value")
    return _related(means, tests, by, min_n, alpha)


def relation_trial(panel: DataFrame, events: DataFrame, edges: DataFrame, y: str, conditions: Sequence[tuple[str, str, float]] = (), min_n: int = 30, perms: int = 1000, alpha: float = 0.05, seed: int = 7, entity: str = "symbol", day: str = "trade_date", at: str = "link_date", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """relation_test() over relation_panel(panel, events, edges, take=by), without making the panel first.

    An instrument's row stands in the panel once for each event of its date that isn't its own, so percentiles, counts and
    means follow from weights, and from the related pairs, which are few. Only the draws need the pairs' keys: they are gone
    over once, and what may be labelled is kept. Events have an entity, a date and their groups.
    """
    by = list(by)
    e = written(events.select(F.col(entity).alias("x"), F.col(day).alias("d"), *by).dropna().distinct())
    own = panel.where(F.col(y).isNotNull()).select(F.col(entity).alias("y"), F.col(day).alias("d"), F.col(y).cast("double").alias("_y"), *dict.fromkeys(c for c, *_ in conditions))
    own = own.join(e.groupBy(*by, "d").agg(F.count("*").alias("_e")), "d").join(e.select(F.col("x").alias("y"), "d", *by, F.lit(1).alias("_own")), ["y", "d", *by], "left")
    rows = written(own.withColumn("_w", F.col("_e") - F.coalesce("_own", F.lit(0))).where("_w > 0 AND y IS NOT NULL").drop("_e", "_own"))
    ok = rows
    for k, (c, how, share) in enumerate(conditions):
        ok = ok.join(weighted_quantile(rows, by, c, share, "_w", f"_b{k}"), by)
        ok = ok.where(F.col(c) >= F.col(f"_b{k}") if how == ">=" else F.col(c) <= F.col(f"_b{k}"))
    ok = written(ok.select("y", "d", *by, "_y", "_w")) if conditions else ok.select("y", "d", *by, "_y", "_w")
    first = first_links(edges, at).where("a <> b")
    ends = first.select(F.col("a").alias("x"), F.col("b").alias("y"), at).unionByName(first.select(F.col("b").alias("x"), F.col("a").alias("y"), at))
    linked = e.join(ends, "x").where(F.col(at) <= F.col("d")).join(ok, ["y", "d", *by]).groupBy(*by, "d").agg(F.count("*").alias("_k"), F.sum("_y").alias("_l"))
    strata = ok.groupBy(*by, "d").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_y")).alias("_t")).join(linked, [*by, "d"], "left")
    strata = written(strata.fillna(0, ["_k", "_l"]))
    n, k, t, s = (F.sum(c) for c in ("_n", "_k", "_t", "_l"))
    in_, out = s / F.nullif(k, F.lit(0)), (t - s) / F.nullif(n - k, F.lit(0))
    means = strata.groupBy(*by).agg(n.alias("n"), k.alias("n_linked"), in_.alias("linked_mean"), out.alias("other_mean"))
    mixed = written(strata.where("_k > 0 AND _k < _n"))
    whole = mixed.groupBy(*by).agg(k.alias("_k"), n.alias("_n"), t.alias("_t"), (in_ - out).alias("effect"))
    # Pairs meet by date and part of the instruments, by number: what goes in is small beside them.
    part, many = F.pmod(F.xxhash64("y"), F.lit(PARTS)).cast("int"), int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = ok.drop("_w").join(mixed.select(*by, "d", "_k", "_n"), [*by, "d"]).withColumn("_part", part).repartition(many, *by, "d", "_part")
    dealt = written(e.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))))
    pairs = left.join(dealt, [*by, "d", "_part"]).where("x <> y").select(*by, "d", "_n", "_k", F.concat_ws("|", *[F.col(c).cast("string") for c in ("x", "y", "d")]).alias("_key"), "_y")
    one = drawn_sums(pairs, by, "d", perms, seed, strata=mixed).join(whole, by).withColumn("_e", F.col("_s") / F.col("_k") - (F.col("_t") - F.col("_s")) / (F.col("_n") - F.col("_k")))
    tests = one.groupBy(*by).agg(((F.count_if(F.abs("_e") >= F.abs("effect") - 1e-12) + 1) / (F.lit(perms) + 1)).alias("p_value"))
    return _related(means, tests, by, min_n, alpha)


def _related(means: DataFrame, tests: DataFrame, by: Sequence[str], min_n: int, alpha: float) -> DataFrame:
    can = (F.col("n") >= min_n) & (F.col("n_linked") >= 3) & (F.col("n") - F.col("n_linked") >= 3) & F.col("p_value").isNotNull()
    return means.join(tests, list(by), "left").withColumn("verdict", F.when(~can, "UNMEASURABLE").when(F.col("p_value") <= alpha, "HOLDS").otherwise("FAILS"))


def placebo_trial(pairs: DataFrame, covariates: Sequence[str], key: Sequence[str], y: str = "r", placebo: str = "is_placebo", perms: int = 500, alpha: float = 0.05, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Per group of matched pairs: the trial on its placebo pairs, which carry no news, and on the others, gated by it.

    placebo_state: PASSED, FAILED (significant, so the group is unusable) or UNMEASURED (no placebo pairs). A failed
    placebo leaves att and p_value null: nothing else about the group counts.
    """
    fake = matched_att(pairs.where(F.col(placebo)), covariates, key, y, perms, by=by).select(*by, F.col("att").alias("placebo_att"), F.col("p_value").alias("placebo_p"), F.col("n_pairs").alias("n_placebo"))
    real = matched_att(pairs.where(~F.col(placebo)), covariates, key, y, perms, by=by).select(*by, "att", "p_value", "n_pairs")
    out = real.join(fake, list(by), "full")
    failed = F.coalesce(F.col("placebo_p") < alpha, F.lit(False))
    state = F.when(F.col("placebo_p").isNull(), "UNMEASURED").when(failed, "FAILED").otherwise("PASSED")
    return out.withColumn("placebo_state", state).withColumn("att", F.when(~failed, F.col("att"))).withColumn("p_value", F.when(~failed, F.col("p_value")))


def probe_variants(pairs: DataFrame, slots: Sequence[str], covariates: Sequence[str], key: Sequence[str], y: str = "r", max_probes: int = 12, perms: int = 500, alpha: float = 0.05, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Per group: a trial for each observed value of each slot, most frequent first, up to max_probes with the baseline (all pairs), which is always there.

    Every pair counts once for the baseline and once for each of its slots' values: one grouped trial. significant: p below
    alpha / max_probes.
    """
    values = F.array(F.struct(F.lit("").alias("slot"), F.lit("").alias("value")), *[F.struct(F.lit(s).alias("slot"), F.col(s).cast("string").alias("value")) for s in slots])
    long = pairs.withColumn("_v", F.explode(values)).where("_v.value IS NOT NULL").withColumn("slot", F.col("_v.slot")).withColumn("value", F.col("_v.value")).drop("_v")
    seen = long.groupBy(*by, "slot", "value").agg(F.count("*").alias("_n"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("slot") != "").cast("int"), F.desc("_n"), "slot", "value"))
    menu = seen.withColumn("nth", nth).where(F.col("nth") <= max_probes).select(*by, "slot", "value", "nth")
    tried = matched_att(long.join(F.broadcast(menu), [*by, "slot", "value"]), covariates, key, y, perms, by=[*by, "slot", "value"])  # max_probes rows a group
    return tried.join(menu, [*by, "slot", "value"]).withColumn("significant", F.col("p_value") < alpha / max_probes)


def cluster_spikes(excess: DataFrame, spikes: DataFrame, labels: DataFrame, q: float = 0.9, min_members: int = 3, key: str = "symbol", order: str = "trade_date", label: str = "label") -> DataFrame:
    """Per cluster of min_members or more: how many members spike on days of extreme excess return (its size at or above the q-quantile), and on the others.

    excess: label, order, excess. spikes: key, order, of members that spike that day. labels: key, label.
    """
    size = labels.groupBy(label).agg(F.count("*").alias("members")).where(F.col("members") >= min_members)
    counts = spikes.select(key, order).distinct().join(labels, key).groupBy(label, order).agg(F.count("*").alias("_k"))
    days = excess.where(F.col("excess").isNotNull()).select(label, order, F.abs("excess").alias("_e")).join(size, label).join(counts, [label, order], "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    bound = days.groupBy(label).agg(F.percentile("_e", F.lit(q)).alias("_b"))
    hi = F.col("_e") >= F.col("_b")
    share = lambda x: F.avg(F.when(hi, x.cast("int")))
    return days.join(bound, label).groupBy(label, "members").agg(
        F.avg(F.when(hi, F.col("_k"))).alias("spikes_extreme"), F.avg(F.when(~hi, F.col("_k"))).alias("spikes_ordinary"), share(F.col("_k") >= min_members).alias("share_several"), share(F.col("_k") == 0).alias("share_none")
    )


def _by_hour(spans: DataFrame, start: Column) -> DataFrame:
    """spans with _hour: a row for each hour from start to a span's end, so that a join by time is one by equality. A span that ends before start has none."""
    first, last = F.date_trunc("hour", start), F.date_trunc("hour", F.col("w_end"))
    return spans.where(last >= first).withColumn("_hour", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))))


def window_facts(bars: DataFrame, layers: DataFrame, members: DataFrame, events: DataFrame, windows: DataFrame, day: date, key: str = "fund", top: int = 3, ts: str = "ts") -> DataFrame:
    """The facts of each (key, window) of a day: how far it moved since the day before (gap + intraday), in the window, by layers, and what stood in it.

    bars: the day's and earlier bars of keys. layers: key, market, sector, idio. members: key, constituent, contribution, r.
    events: key, event_id, event_time. windows: window_id, w_start, w_end of the day, a bounded list. A window without
    bars has no facts but an error; one whose prices have no log has facts, but neither return nor direction.
    """
    gap = gap_return(bars, key, ts).where(F.col("trade_date") == F.lit(day)).select(key, "day_open", "gap")
    own = bars.where(F.to_date(ts) == F.lit(day))
    spans = windows.select("window_id", "w_start", "w_end")
    moved = window_return(own, spans, key, ts)
    # Up to a window's end: the last close then. Windows meet bars and events by equal hours of the day.
    until = own.withColumn("_hour", F.date_trunc("hour", ts)).join(_by_hour(spans, F.lit(day).cast("timestamp")), "_hour").where(F.col(ts) < F.col("w_end")).groupBy(key, "window_id").agg(F.max_by("close", ts).alias("_c"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("contribution").desc_nulls_last(), "constituent"))
    named = members.withColumn("_k", rank).groupBy(key).agg(
        F.count_if(F.col("r") > 0).alias("advancers"),
        F.count_if(F.col("r") < 0).alias("decliners"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= top, F.struct("_k", F.col("constituent").cast("string").alias("c"))))), lambda x: x["c"]), ",").alias("contributors"),
    )
    inside = events.withColumn("_hour", F.date_trunc("hour", "event_time")).join(_by_hour(spans, F.col("w_start")), "_hour").where((F.col("event_time") >= F.col("w_start")) & (F.col("event_time") <= F.col("w_end"))).groupBy(key, "window_id").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))
    out = moved.join(until, [key, "window_id"], "left").join(gap, key, "left").join(layers.select(key, "market", "sector", "idio"), key, "left").join(named, key, "left").join(inside, [key, "window_id"], "left")
    known = F.col("n_bars") > 0
    facts = {
        "header_return": F.col("gap") + F.log(F.try_divide("_c", "day_open")),
        "market": F.col("market"),
        "sector": F.col("sector"),
        "idio": F.col("idio"),
        "advancers": F.col("advancers"),
        "decliners": F.col("decliners"),
        "contributors": F.col("contributors"),
        "n_events": F.coalesce("n_events", F.lit(0).cast("long")),
        "first_event": F.col("first_event"),
        "direction": F.when(F.col("window_return") > 0, "up").when(F.col("window_return") < 0, "down").when(F.col("window_return") == 0, "flat"),
    }
    return out.select(key, "window_id", "window_return", *[F.when(known, x).alias(c) for c, x in facts.items()], F.when(~known, "no bars in the window").alias("error"))


def _descend(gram: np.ndarray, rhs: np.ndarray, n: float, penalty: float, free: np.ndarray, rounds: int = 500, close: float = 1e-10) -> np.ndarray:
    """Lasso coefficients from centred moments alone: coordinate descent on gram (X'X) and rhs (X'y), free columns unpenalised."""
    d, size = np.zeros(len(rhs)), np.diag(gram)
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(size > 1e-12):
            pull = rhs[j] - gram[j] @ d + size[j] * d[j]
            new = pull / size[j] if free[j] else np.sign(pull) * max(abs(pull) - penalty * n, 0.0) / size[j]
            most = max(most, abs(new - d[j]))
            d[j] = new
        if most < close:
            break
    return d


def lasso_moderation(pairs: DataFrame, moderators: Sequence[str], y: str, stratum: str, key: Sequence[str], free: Sequence[str] = (), penalty: float = 0.001, perms: int = 200, subsamples: int = 200, share: float = 0.5, stable: float = 0.7, alpha: float = 0.05, collinear: float = 0.95, seed: int = 7) -> DataFrame:
    """Per moderator: whether it changes the effect y of pairs, by a lasso with selection inside the test.

    y ~ free columns (unpenalised) + moderators. Of columns that correlate by `collinear` or more the first stays. pi: how
    often a moderator is chosen in subsamples of the share; p_value: maxT step-down, the largest coefficient against the
    largest ones under shuffling the moderators' rows within strata; selected: pi >= stable and p < alpha; coefficient: least
    squares on what is selected; low, high: the middle 95 % of the subsamples' |coefficients|, by which rank goes, with
    ties where they overlap.

    Each draw is a hash of the row's key, so Spark sums the moments of every draw in one grouped pass; only these sums, a
    matrix of the columns' number for each draw, are solved, on the driver.
    """
    names = [*free, *moderators]
    p = len(names)
    rows = pairs.dropna(subset=[*names, y]).select(stratum, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)], F.col(y).cast("double").alias("y"), F.xxhash64(*key).alias("_key"))
    pen = range(len(free), p)

    def moments(df: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Of each draw: rows, centred X'X and X'y."""
        cols = [f"x{i}" for i in range(p)] + ["y"]
        sums = [F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
        out = {}
        for r in df.groupBy("_p").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)], *sums).collect():
            s = np.array([r[f"s_{i}"] for i in range(p + 1)])
            m = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) - np.outer(s, s) / r.n
            out[r._p] = (float(r.n), m[:p, :p], m[:p, p])
        return out

    whole = moments(rows.withColumn("_p", F.lit(0))).get(0)
    schema = "name string, pi double, p_value double, selected boolean, coefficient double, low double, high double, rank int, reason string"
    spark = pairs.sparkSession
    if whole is None or whole[0] < 4:
        return spark.createDataFrame([(c, None, None, False, None, None, None, None, "too few pairs") for c in moderators], schema)
    n, gram, rhs = whole
    reasons: dict[str, str] = {}
    live = np.ones(p, bool)
    sd = np.sqrt(np.maximum(np.diag(gram), 0))
    for i in range(p):
        for j in range(i + 1, p):
            if live[i] and live[j] and j >= len(free) and sd[i] * sd[j] > 1e-12 and abs(gram[i, j] / (sd[i] * sd[j])) >= collinear:
                live[j] = False
                reasons[names[j]] = f"collinear with {names[i]}"
    fr = np.arange(p) < len(free)

    def solve(m: tuple[float, np.ndarray, np.ndarray], keep: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(keep)
        out = np.zeros(p)
        out[at] = _descend(m[1][np.ix_(at, at)], m[2][at], m[0], penalty, fr[at])
        return out

    # Shuffling within a stratum: row k of the key's order gets the moderators of row k of the draw's order.
    drawn = rows.withColumn("_p", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    w = Window.partitionBy("_p", stratum)
    order = F.row_number().over(w.orderBy("_key", "y"))
    mixed = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "_p", "_key"), "_key", "y"))
    own = drawn.select("_p", stratum, "y", *[f"x{i}" for i in range(len(free))], order.alias("_n"))
    other = drawn.select("_p", stratum, *[f"x{i}" for i in pen], mixed.alias("_n"))
    shuffled = moments(own.join(other, ["_p", stratum, "_n"]))
    half = rows.withColumn("_p", F.explode(F.sequence(F.lit(1), F.lit(subsamples)))).where(F.pmod(F.xxhash64(F.lit(seed + 1), "_p", "_key"), F.lit(1_000_000)) < int(share * 1_000_000))
    draws = np.array([solve(m, live) for _, m in sorted(moments(half).items())]).reshape(-1, p)
    pi = (draws != 0).mean(axis=0) if len(draws) else np.zeros(p)
    p_value: dict[int, float] = {}
    left = live & ~fr
    while left.any():
        d = np.abs(solve(whole, left | fr))
        best = int(np.argmax(np.where(left, d, -1)))
        null = np.array([np.abs(solve(m, left | fr))[left].max() for m in shuffled.values()])
        p_value[best] = float((1 + (null >= d[best] - 1e-15).sum()) / (1 + len(null)))
        if p_value[best] >= alpha:
            break
        left[best] = False
    chosen = np.array([bool(live[i] and not fr[i] and pi[i] >= stable and p_value.get(i, 1.0) < alpha) for i in range(p)])
    at = np.flatnonzero(chosen | (fr & live))
    ols = np.zeros(p)
    if len(at):
        ols[at] = np.linalg.lstsq(gram[np.ix_(at, at)], rhs[at], rcond=None)[0]
    size = np.abs(draws)
    low, high = (np.quantile(size, q, axis=0) if len(draws) else np.zeros(p) for q in (0.025, 0.975))
    rank: dict[int, int] = {}
    head, bound = 0, np.inf
    for k, i in enumerate(sorted(np.flatnonzero(chosen), key=lambda i: (-size[:, i].mean(), names[i])), 1):
        if head == 0 or high[i] < bound:
            head, bound = k, low[i]
        rank[int(i)] = head
    out = [(names[i], float(pi[i]), p_value.get(i), bool(chosen[i]), float(ols[i]) if chosen[i] else None, float(low[i]), float(high[i]), rank.get(i), reasons.get(names[i])) for i in pen]
    return spark.createDataFrame(out, schema)
