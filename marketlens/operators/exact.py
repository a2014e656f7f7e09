"""Exact order statistics of groups of any size: no group's values, and no stratum of a draw, meet in one task unless they are few."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.sink import written

#: Values of a group that one task takes at most.
SMALL = 100_000
#: Steps of the grid by which larger groups are narrowed, and its accuracy: a pass leaves about 3 / GRID of a group.
GRID, ACCURACY = 100, 1_000
#: Rows of a stratum that one task takes at most.
STRATUM = 4_096


def _wanted(df: DataFrame, by: Sequence[str], wanted: Sequence[tuple[str, str, float]]) -> DataFrame:
    """by, _w (which of wanted), _v: a row a value."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("w"), F.col(c).cast("double").alias("v")) for k, (_, c, _) in enumerate(wanted)]))
    return df.select(*by, each.alias("_x")).select(*by, F.col("_x.w").alias("_w"), F.col("_x.v").alias("_v")).where("_v IS NOT NULL")


def quantiles(df: DataFrame, by: Sequence[str], wanted: Sequence[tuple[str, str, float]], small: int = SMALL) -> DataFrame:
    """by, and for each (name, column, share) of wanted the column's exact quantile, between order statistics as F.percentile().

    A group with more than small values is narrowed first: sketches (mergeable, of bounded size) give two values that
    should enclose the order statistic, counts of what is below, at, between and above them say where it is. Each pass drops
    the two values at least, and about all but 3 of 100 of what is left; what the counts find is exact, however good the
    sketch. Once few enough are left these are sorted.
    """
    by, key = list(by), [*by, "_w", "_k"]
    long = _wanted(df, by, wanted)
    share = F.element_at(F.array(*[F.lit(float(s)) for *_, s in wanted]), F.col("_w") + 1)
    n = long.groupBy(*by, "_w").agg(F.count("*").alias("_n")).withColumn("_r", share * (F.col("_n") - 1))
    ranks = F.array_distinct(F.array(F.floor("_r"), F.ceil("_r")))
    none = F.lit(None).cast("double")
    # A target is a rank (from 0) of a group; it lies among `inside` values between low and high, of which none is either.
    state = written(n.select(*by, "_w", "_r", F.explode(ranks).alias("_k"), none.alias("_low"), none.alias("_high"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), none.alias("_found")))
    within = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") < F.col("_high")))
    while (large := state.where(F.col("_found").isNull() & (F.col("_inside") > small))).limit(1).count():
        rest = [c for c in state.columns if c not in key]
        grid = F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY)
        at = (F.col("_k") - F.col("_below")) / F.col("_inside") * GRID
        cut = long.join(large, [*by, "_w"]).where(within).groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], grid.alias("_g"))
        cut = cut.withColumn("_a", F.element_at("_g", F.greatest(F.floor(at) - 1, F.lit(0)).cast("int") + 1)).withColumn("_b", F.element_at("_g", F.least(F.ceil(at) + 1, F.lit(GRID)).cast("int") + 1)).drop("_g")
        zones = {"_z0": F.col("_v") < F.col("_a"), "_z1": F.col("_v") == F.col("_a"), "_z2": (F.col("_v") > F.col("_a")) & (F.col("_v") < F.col("_b")), "_z3": (F.col("_v") == F.col("_b")) & (F.col("_b") > F.col("_a")), "_z4": F.col("_v") > F.col("_b")}
        held = long.join(written(cut), [*by, "_w"]).where(within).groupBy(*key).agg(*[F.first(c).alias(c) for c in [*rest, "_a", "_b"]], *[F.count_if(z).alias(name) for name, z in zones.items()])
        upto, nth = [F.col("_below")], F.col("_k")
        for name in zones:
            upto.append(upto[-1] + F.col(name))
        zone = F.when(nth < upto[1], 0).when(nth < upto[2], 1).when(nth < upto[3], 2).when(nth < upto[4], 3).otherwise(4)
        pick = lambda *xs: F.element_at(F.array(*xs), F.col("_zone") + 1)
        low, high = F.col("_low"), F.col("_high")
        moved = held.withColumn("_zone", zone).withColumn("_to", F.struct(pick(low, none, F.col("_a"), none, F.col("_b")).alias("low"), pick(F.col("_a"), none, F.col("_b"), none, high).alias("high"), pick(*upto[:5]).alias("below"), pick(*[F.col(z) for z in zones]).alias("inside"), pick(none, F.col("_a"), none, F.col("_b"), none).alias("found")))
        moved = moved.select(*by, "_w", "_r", "_k", *[F.col(f"_to.{c}").alias(f"_{c}") for c in ("low", "high", "below", "inside", "found")])
        state = written(moved.unionByName(state.where(F.col("_found").isNotNull() | (F.col("_inside") <= small))))
    left = long.join(state.where("_found IS NULL"), [*by, "_w"]).where(within)
    nth = F.element_at(F.sort_array(F.collect_list("_v")), (F.first("_k") - F.first("_below")).cast("int") + 1)  # small values at most
    found = left.groupBy(*key).agg(F.first("_r").alias("_r"), nth.alias("_found")).unionByName(state.where("_found IS NOT NULL").select(*key, "_r", "_found"))
    between = F.min("_found") + (F.max("_found") - F.min("_found")) * (F.first("_r") - F.floor(F.first("_r")))
    each = found.groupBy(*by, "_w").agg(between.alias("_q"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("_w") == k, F.col("_q"))).alias(name) for k, (name, *_) in enumerate(wanted)])


def weighted_quantile(df: DataFrame, by: Sequence[str], value: str, share: float, weight: str, name: str) -> DataFrame:
    """by, name: quantiles() of value where each row stands weight (a whole number) times. Weights are summed within ranges of values, and over the ranges before, so no group's values meet in one task."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(weight).alias("_c"))
    ranged = written(counts.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))  # a row a range
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_s")
    rank = share * (F.sum("_s").over(Window.partitionBy(*by)) - 1)
    upto = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy("_v"))
    at = ranged.join(parts.select(*by, "_range", before.alias("_before"), rank.alias("_r")), [*by, "_range"]).withColumn("_to", upto + F.col("_before"))
    holds = lambda k: F.max(F.when((F.col("_to") > k) & (F.col("_to") - F.col("_c") <= k), F.col("_v")))
    ends = at.groupBy(*by).agg(holds(F.floor("_r")).alias("_a"), holds(F.ceil("_r")).alias("_b"), F.first("_r").alias("_r"))
    return ends.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_r") - F.floor("_r"))).alias(name))


def digits(key: Column, draw: Column, seed: int) -> Column:
    """The 8 hex digits of a row's MD5 that belong to a draw (from 1); four draws share one. Any engine has this hash."""
    block = F.floor((draw - 1) / 4).cast("int")
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), block, key)), ((draw - 1) % 4 * 8 + 1).cast("int"), F.lit(8))


def drawn_sums(rows: DataFrame, by: Sequence[str], stratum: str, draws: int, seed: int, most: int = STRATUM, strata: DataFrame | None = None) -> DataFrame:
    """by, _p, _s: for each draw the sum of _y over the rows that it labels: of each stratum the _k with the least (digits, _key).

    rows: by, stratum, _n (rows of the stratum), _k, _key, _y. Strata of at most `most` rows are gathered once, and drawn
    from where they are, so what is shuffled is the rows and not rows x draws. Of larger ones, counts and sums by the first two
    digits say which digits are labelled as a whole, and which one in part; only the rows with that one are looked at by their
    next two, until few enough are left. strata: by, stratum, _k, _n, where they are known, which saves a pass over the rows.
    """
    by = list(by)
    few = rows.where(F.col("_n") <= most).groupBy(*by, stratum).agg(F.first("_k").alias("_k"), F.collect_list(F.struct("_key", "_y")).alias("_l"))
    each = few.withColumn("_p", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    ordered = F.sort_array(F.transform("_l", lambda r: F.struct(digits(r["_key"], F.col("_p"), seed).alias("x"), r["_key"].alias("key"), r["_y"].alias("y"))))
    own = F.aggregate(F.slice(ordered, 1, F.col("_k").cast("int")), F.lit(0.0), lambda a, r: a + r["y"])
    out = each.select(*by, "_p", own.alias("_s"))
    many = rows.where(F.col("_n") > most)
    sizes = written(many.groupBy(*by, stratum).agg(F.first("_k").alias("_k"), F.first("_n").alias("_n")) if strata is None else strata.select(*by, stratum, "_k", "_n").where(F.col("_n") > most))
    # Where few are labelled, what can be among them is told by the digits alone: so many are expected below a bound, and some more.
    share = (F.col("_k") + 6 * F.sqrt("_k") + 20) / F.col("_n")
    for rare in (True, False):
        own = sizes.where((share <= 1 / 8) if rare else (share > 1 / 8))
        if own.limit(1).count():
            part = many.join(own.select(*by, stratum), [*by, stratum], "left_semi")
            out = out.unionByName(_below(part, own, share, by, stratum, draws, seed, most) if rare else _selected(_all_drawn(part, draws, seed), by, stratum, most))
    return out.groupBy(*by, "_p").agg(F.sum("_s").alias("_s"))


def _all_drawn(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """rows for each draw _p, with its digits _x."""
    return rows.withColumn("_p", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_x", digits(F.col("_key"), F.col("_p"), seed))


def _below(rows: DataFrame, sizes: DataFrame, share: Column, by: list[str], stratum: str, draws: int, seed: int, most: int) -> DataFrame:
    """by, _p, _s, as _selected(): from the rows whose digits are below the share that a stratum labels and some more. Draws that find too few there, one in a thousand million, look at all their rows."""
    bound = F.lpad(F.lower(F.hex(F.floor(share * 2.0**32).cast("long"))), 8, "0")
    hashes = F.transform(F.sequence(F.lit(0), F.lit((draws - 1) // 4)), lambda b: F.md5(F.concat_ws("|", F.lit(seed), b, F.col("_key"))))
    names = [*by, stratum, "_k", "_key", "_y"]
    one = rows.select(*names, bound.alias("_bound"), F.posexplode(hashes).alias("_b", "_h"))
    x = lambda i: F.substring("_h", 8 * i + 1, 8)
    one = one.where((x(0) < F.col("_bound")) | (x(1) < F.col("_bound")) | (x(2) < F.col("_bound")) | (x(3) < F.col("_bound")))
    each = F.explode(F.array(*[F.struct((F.col("_b") * 4 + i + 1).alias("p"), x(i).alias("x")) for i in range(4)]))
    found = one.select(*names, "_bound", each.alias("_z")).select(*names, F.col("_z.p").alias("_p"), F.col("_z.x").alias("_x"), "_bound")
    found = written(found.where((F.col("_x") < F.col("_bound")) & (F.col("_p") <= draws)).drop("_bound"))
    key = [*by, stratum, "_p"]
    wanted = sizes.select(*by, stratum, "_k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_p"))
    short = written(wanted.join(found.groupBy(*key).agg(F.count("*").alias("_c")), key, "left").where(F.coalesce("_c", F.lit(0)) < F.col("_k")).select(*key))
    if not short.limit(1).count():
        return _selected(found, by, stratum, most)
    rest = _all_drawn(rows, draws, seed).join(short, key, "left_semi")
    return _selected(found.join(short, key, "left_anti").unionByName(rest.select(found.columns)), by, stratum, most)


def _selected(drawn: DataFrame, by: list[str], stratum: str, most: int) -> DataFrame:
    """by, _p, _s: sums over parts of large strata, found digit by digit. drawn: rows (_key, _y, _k) of draws _p with their digits _x."""
    key = [*by, stratum, "_p"]
    out, open_, at = None, drawn.select(*key, "_key", "_y", "_x", F.col("_k").alias("_left")), 1
    while True:
        last = at > 7
        digit = F.substring("_x", at, 2) if not last else F.lit("")
        counts = open_.groupBy(*key, digit.alias("_d")).agg(F.count("*").alias("_cnt"), F.sum("_y").alias("_sum"), F.first("_left").alias("_left"))
        # 256 digits at most.
        told = counts.groupBy(*key).agg(F.first("_left").alias("_left"), F.sort_array(F.collect_list(F.struct("_d", "_cnt", "_sum"))).alias("_l"))
        fold = F.aggregate("_l", F.struct(F.col("_left").alias("left"), F.lit(0.0).alias("s"), F.lit(None).cast("string").alias("d"), F.lit(0).cast("long").alias("c")), lambda a, x: F.when(a["d"].isNotNull() | (a["left"] == 0), a).when(x["_cnt"] <= a["left"], F.struct((a["left"] - x["_cnt"]).alias("left"), (a["s"] + x["_sum"]).alias("s"), a["d"].alias("d"), a["c"].alias("c"))).otherwise(F.struct(a["left"].alias("left"), a["s"].alias("s"), x["_d"].alias("d"), x["_cnt"].alias("c"))))
        told = written(told.select(*key, fold.alias("_f")).select(*key, F.col("_f.s").alias("_s"), F.col("_f.left").alias("_left"), F.col("_f.d").alias("_d"), F.col("_f.c").alias("_c")))
        whole = told.select(*by, "_p", "_s")
        out = whole if out is None else out.unionByName(whole)
        part = told.where("_d IS NOT NULL AND _left > 0").select(*key, "_left", "_d", "_c")
        inner = open_.drop("_left", "_c").withColumn("_d", digit).join(part, [*key, "_d"]).drop("_d")
        # Rows that share a digit in part: a few are sorted; keys that share all digits are few, or are each other's copies.
        done = inner if last else inner.where(F.col("_c") <= most)
        nth = F.slice(F.sort_array(F.collect_list(F.struct("_x", "_key", "_y"))), 1, F.first("_left").cast("int"))
        out = out.unionByName(done.groupBy(*key).agg(F.aggregate(nth, F.lit(0.0), lambda a, r: a + r["_y"]).alias("_s")).select(*by, "_p", "_s"))
        if last or not part.where(F.col("_c") > most).limit(1).count():
            return out
        open_, at = written(inner.where(F.col("_c") > most).drop("_c")), at + 2
