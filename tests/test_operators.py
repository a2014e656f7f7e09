"""Small frames with expected rows: ties, nulls, empty tables, single rows."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.functions import scalar
from marketlens.operators import bars, events, explain, funds, panel, pit, quality, reporting, reshape, stats
from marketlens.sources import scan, sink
from marketlens.streaming import minute


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_asof_ties_nulls_and_no_match(spark):
    left = spark.createDataFrame([(1, 1, 10), (2, 1, 5), (3, None, 10), (4, 2, 10), (5, 1, None)], "id int, k int, t int")
    right = spark.createDataFrame([(1, 10, "a"), (1, 7, "b"), (1, 7, "c"), (None, 1, "n"), (1, None, "x")], "k int, rt int, v string")
    back = pit.asof_join_backward(left, right, ["k"], "t", "rt", ["v"])
    assert rows(back.select("id", "v")) == [(1, "a"), (2, None), (3, None), (4, None), (5, None)]
    strict = pit.asof_join_backward(left, right, ["k"], "t", "rt", ["v"], allow_exact=False)
    assert rows(strict.where("id = 1").select("id", "v")) == [(1, "c")]
    ahead = pit.asof_join_forward(left, right.select("k", "rt"), ["k"], "t", "rt", "next")
    assert rows(ahead.select("id", "next")) == [(1, 10), (2, 7), (3, None), (4, None), (5, None)]


def test_asof_is_one_shuffle_without_nested_loops(spark):
    left = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("t"))
    right = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("rt"), F.lit(1).alias("v"))
    plan = pit.asof_join_backward(left, right, ["k"], "t", "rt", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_clamp_needs_a_column(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 3))], "id int, available_at timestamp")
    assert rows(pit.clamp_as_of(df, dt.datetime(2024, 1, 2)).select("id")) == [(1,)]
    with pytest.raises(ValueError):
        pit.clamp_as_of(df.drop("available_at"), dt.datetime(2024, 1, 2))


def test_snapshots_skip_future_and_sparse(spark):
    d = dt.date
    h = spark.createDataFrame([("f", d(2024, 1, 1), 1.0), ("f", d(2024, 1, 2), None), ("f", d(2024, 2, 1), 2.0), ("g", d(2024, 3, 1), 3.0)], "fund string, as_of_date date, w double")
    assert rows(pit.snapshot_as_of(h, ["fund"], "as_of_date", d(2024, 1, 15))) == [("f", d(2024, 1, 2), None)]
    assert rows(pit.snapshot_skip_sparse(h, ["fund"], "as_of_date", "w", d(2024, 1, 15))) == [("f", d(2024, 1, 1), 1.0)]
    assert [r for r in rows(pit.snapshot_as_of_or_next(h, ["fund"], "as_of_date", d(2024, 1, 15)).select("fund", "is_future"))] == [("f", False), ("g", True)]


def test_rollup_keeps_time_order_not_arrival(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 9, m)
    b = spark.createDataFrame([("a", t(3), 3.0, 3.0, 3.0, 3.0, 1), ("a", t(1), 1.0, 1.0, 1.0, 1.0, 2), ("a", t(6), 9.0, 9.0, 9.0, 9.0, 5)], "symbol string, ts timestamp, open double, high double, low double, close double, volume long")
    got = rows(bars.rollup_bars(b, 5, dt.datetime(2024, 1, 1, 9, 5)))
    assert got == [("a", t(0), 1.0, 3.0, 1.0, 3.0, 3, t(5))]


def test_zero_variance_and_single_rows_are_null(spark):
    p = spark.createDataFrame([("a", k, 1.0) for k in range(6)] + [("b", 0, 2.0)], "symbol string, trade_date int, r double")
    assert {r.r_z for r in panel.rolling_z(p, "r", 3, "r_z").collect()} == {None}
    assert {r.beta for r in panel.rolling_beta(p.withColumn("x", F.lit(1.0)), "r", "x", 3).collect()} == {None}


def test_layers_add_up(spark):
    r = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.3), ("c", 1, -0.2), ("d", 1, None)], "symbol string, trade_date int, r double")
    s = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "symbol string, sector string")
    for x in funds.loo_layers(r, s).collect():
        if x.cluster is not None:
            assert abs(x.market + x.cluster + x.idio - x.r) < 1e-12


def test_gates_collect_all_reasons(spark):
    df = spark.createDataFrame([(1.0, 0.5, 2.0, 1.0, -1), (1.0, 2.0, 0.5, 1.0, None)], "open double, high double, low double, close double, volume long")
    ok, bad = quality.apply_rules(df, quality.ohlcv_rules())
    assert ok.count() == 1
    assert bad.first().reasons == ["negative_volume", "high_below_low", "high_below_body", "low_above_body"]


def test_merge_latest_compares_instants_and_prefers_incoming(spark):
    old = spark.createDataFrame([(1, "2024-01-01T09:00:00+09:00", "old"), (2, "2024-01-01T00:00:00Z", "old")], "k int, fetched_at string, v string")
    new = spark.createDataFrame([(1, "2024-01-01T00:30:00Z", "new"), (2, "2024-01-01T09:00:00+09:00", "new")], "k int, fetched_at string, v string")
    assert rows(quality.merge_latest(old, new, ["k"], "fetched_at").select("k", "v")) == [(1, "new"), (2, "new")]


def test_vendor_clash_is_left_out_and_reported(spark):
    a = spark.createDataFrame([(1, "A", "2024-01-01"), (2, "A", "2024-01-01")], "k int, vendor string, ts string")
    b = spark.createDataFrame([(1, "B", "2024-01-02")], "k int, vendor string, ts string")
    merged, clash = quality.merge_exclusive_vendor(a, b, ["k"], "vendor", "ts")
    assert rows(merged.select("k")) == [(2,)] and rows(clash.select("k")) == [(1,)]


def test_upsert_tells_nulls_apart(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "k int, v int")
    b = spark.createDataFrame([(1, None), (2, None), (4, 1)], "k int, v int")
    assert rows(sink.upsert_changed(a, b, ["k"], ["v"])) == [(1, None, "unchanged"), (2, None, "updated"), (3, 7, "kept"), (4, 1, "created")]


def test_foreign_writer_is_refused(spark):
    base = f"{sink.shared_dir(spark)}/foreign"
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, "other", d)], "k int, source_vendor string, trade_date date")
    sink.write_partition_overwrite(df, base, ["trade_date"])
    with pytest.raises(ValueError):
        sink.write_day_rebuild(df.withColumn("source_vendor", F.lit("own")), base, d, "own")


def test_missing_sources_are_empty_with_schema(spark):
    df, where = scan.scan_or_empty(spark, ["/no/such/place.parquet"], "a int, b string")
    assert where == "empty" and df.columns == ["a", "b"] and df.count() == 0


def test_filters_are_closed(spark):
    df = spark.range(5)
    assert reshape.filter_typed(df, "id", "in", [1, 2]).count() == 2
    for bad in (("x", "eq", 1), ("id", "like", 1), ("id", "in", range(51))):
        with pytest.raises(ValueError):
            reshape.filter_typed(df, *bad)


def test_novelty_in_order(spark):
    e = spark.createDataFrame([(1, 1, "x", "a", False), (2, 2, "x", "a", False), (3, 3, "x", "b", False), (4, 4, "x", "b", True), (5, 5, None, "a", False)], "event_id int, ts int, issuer string, stage string, is_correction boolean")
    got = events.novelty(e, ["issuer"], {"a": 1, "b": 2}).orderBy("event_id").collect()
    assert [r.novelty for r in got] == ["FIRST", "DUPLICATE_REBROADCAST", "FOLLOW_UP_STAGE", "CORRECTION", "UNKNOWN"]


def test_permutation_finds_a_planted_effect_and_ignores_partitions(spark):
    p = spark.range(600).select(F.lit("t").alias("event_type"), (F.col("id") % 30).alias("day"), "id", (F.col("id") % 4 == 0).cast("int").alias("d"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 + F.when(F.col("id") % 4 == 0, 0.5).otherwise(0)).alias("y"))
    one = stats.stratified_permutation(p, "d", "y", "day", ["id"], perms=100).first()
    two = stats.stratified_permutation(p.repartition(7, "y"), "d", "y", "day", ["id"], perms=100).first()
    assert one.p_value < 0.05 and one.p_value == two.p_value and abs(one.effect - 0.5) < 0.1
    # Without an effect, p is that of numpy's own shuffles of the same rows.
    for seed in (3, 4, 5):
        null = p.withColumn("y", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000)
        got = stats.stratified_permutation(null, "d", "y", "day", ["id"], perms=400).first()
        rows = null.where("day % 2 = 0").toPandas()
        days = [np.flatnonzero(rows.day == k) for k in sorted(set(rows.day))]
        d, y, r, hits = rows.d.to_numpy(), rows.y.to_numpy(), np.random.default_rng(seed), 0
        assert got.n == len(rows)
        for _ in range(2000):
            q = d.copy()
            for i in days:
                q[i] = r.permutation(d[i])
            hits += abs(y[q == 1].mean() - y[q == 0].mean()) >= abs(got.effect) - 1e-12
        assert abs(got.p_value - (hits + 1) / 2001) < 0.08


def test_multi_att_recovers_coefficients(spark):
    p = spark.range(200).select((F.col("id") % 2).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("b")).withColumn("diff", 2.0 * F.col("a") - 1.5 * F.col("b"))
    got = {r.flag: r.att for r in stats.multi_att(p, ["a", "b"], "diff").collect()}
    assert abs(got["a"] - 2) < 1e-9 and abs(got["b"] + 1.5) < 1e-9


def test_multi_att_draws_signs_and_compares_with_each_alone(spark):
    """Each draw flips whole pairs and fits all flags anew; a treatment alone takes what the other one does."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    y = 0.4 * a + rng.normal(size=300)
    y[b == 1] += 0.05
    rows = [(f"k{i}", int(a[i]), int(b[i]), float(y[i])) for i in range(300)] + [("none", 1, 1, None)]
    out = stats.multi_att(spark.createDataFrame(rows, "k string, a int, b int, diff double"), ["a", "b"], "diff", ["k"], 200)
    got = {r.flag: r for r in out.collect()}
    x = np.stack([a, b], 1).astype(float)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    signs = [np.where([hashlib.md5(f"7|{(p - 1) // 32}|k{i}".encode()).hexdigest()[(p - 1) % 32] < "8" for i in range(300)], 1, -1) for p in range(1, 201)]
    null = np.array([np.linalg.lstsq(x, y * s, rcond=None)[0] for s in signs])
    for j, (f, flag) in enumerate((("a", a), ("b", b))):
        r, own = got[f], flag == 1
        assert abs(r.att - beta[j]) < 1e-9 and r.n == 300 and r.n_treated == r.solo_n == own.sum()
        assert r.p_value == (sum(abs(null[:, j]) >= abs(beta[j]) - 1e-12) + 1) / 201
        assert abs(r.solo_att - y[own].mean()) < 1e-9
        assert r.solo_p == (sum(abs((y * s)[own].mean()) >= abs(y[own].mean()) - 1e-12 for s in signs) + 1) / 201
    own = spark.createDataFrame([(f"o{i}", 3.0) for i in range(9)], "k string, diff double")
    some = spark.createDataFrame(rows, "k string, a int, b int, diff double")
    got = {r.flag: r for r in stats.multi_att(some, ["a", "b"], "diff", ["k"], 20, solo={"a": own, "b": own.limit(0)}).collect()}
    assert (got["a"].solo_att, got["a"].solo_n) == (3.0, 9) and got["a"].solo_att != got["a"].att
    assert (got["b"].solo_att, got["b"].solo_p, got["b"].solo_n) == (None, None, 0)


def test_trigger_fires_moves_and_reverts_once(spark):
    t = lambda m: dt.datetime(2024, 1, 2, 9, m)
    b = spark.createDataFrame([("s", "u", t(k), c) for k, c in enumerate((100.0, 104.0, 105.0, 108.0, 100.5, 100.2, 96.0))], "session string, symbol string, ts timestamp, close double")
    base = spark.createDataFrame([("s", "u", 100.0)], "session string, symbol string, base double")
    got = minute.price_trigger(b, base).orderBy("ts").collect()
    assert [(r.ts.minute, r.event) for r in got] == [(1, "FIRE"), (3, "FIRE"), (4, "REVERT"), (6, "FIRE")]


def test_scalars(spark):
    one = spark.createDataFrame([("HTTP://Ex.com/a/?utm_source=x&b=2&a=1#f", "ﬁ  x", 5.0, -4.0)], "u string, s string, a double, b double")
    r = one.select(scalar.normalize_url(F.col("u")).alias("u"), scalar.match_text(F.col("s")).alias("s"), scalar.revision(F.col("a"), F.col("b")).alias("r")).first()
    assert (r.u, r.s, r.r) == ("http://ex.com/a?a=1&b=2", "fi x", 9.0 / 4)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "symbol string, trade_date date, r double, lr double, close double, volume long")
    assert panel.abnormal_returns(e, 1).count() == 0
    assert reporting.traffic_summary(e.withColumnRenamed("trade_date", "ts"), dt.datetime(2024, 1, 1), error=F.lit(True)).first()[0:2] == (0, 0)
    assert events.title_duplicates(spark.createDataFrame([], "d string, t string, k int"), "d", "t", "k").count() == 0


def test_lasso_moderation_finds_the_planted_moderator(spark):
    import numpy as np

    r = np.random.default_rng(5)
    rows = []
    for k in range(400):
        a, b, c = r.random(3)
        d = float(r.random() > 0.5)
        rows.append((k, k % 10, d, float(a), float(b), float(c), float(a) + 1e-4 * float(r.random()), 0.01 + 0.03 * d + 0.05 * float(a) + float(r.normal(0, 0.004))))
    df = spark.createDataFrame(rows, "k int, day int, d double, real double, n1 double, n2 double, twin double, y double")
    out = {x.name: x for x in explain.lasso_moderation(df, ["real", "n1", "n2", "twin"], "y", "day", ["k"], free=["d"], perms=40, subsamples=40).collect()}
    assert [n for n, x in out.items() if x.selected] == ["real"]
    assert abs(out["real"].coefficient - 0.05) < 0.005 and out["real"].p_value < 0.05 and out["real"].rank == 1
    assert out["twin"].reason == "collinear with real" and out["twin"].p_value is None
    noise = df.withColumn("y", 0.01 + 0.0001 * (F.xxhash64("k") % 100))
    assert not any(x.selected for x in explain.lasso_moderation(noise, ["real", "n1", "n2"], "y", "day", ["k"], perms=40, subsamples=40).collect())
    none = explain.lasso_moderation(df.limit(0), ["real"], "y", "day", ["k"]).collect()
    assert [x.reason for x in none] == ["too few pairs"]


def test_descent_is_the_lasso(spark):
    """Coefficients from moments against a plain search over the objective, and least squares without a penalty."""
    import numpy as np

    r = np.random.default_rng(1)
    x, e = r.random((80, 3)), r.normal(0, 0.1, 80)
    y = x @ np.array([1.0, 0.0, -0.5]) + e
    xc, yc = x - x.mean(0), y - y.mean()
    free = np.zeros(3, bool)
    assert np.allclose(explain._descend(xc.T @ xc, xc.T @ yc, 80, 0.0, free), np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-6)
    loss = lambda d: 0.5 * ((yc - xc @ d) ** 2).sum() + 0.02 * 80 * np.abs(d).sum()
    d = explain._descend(xc.T @ xc, xc.T @ yc, 80, 0.02, free)
    assert all(loss(d) <= loss(d + step) + 1e-9 for step in r.normal(0, 0.01, (500, 3)))


def test_placebo_gates_the_trial(spark):
    rows = [(e, k, f, 0.1 if (e == "bad" or not f) else (-1) ** k * 0.1) for e in ("good", "bad") for f in (True, False) for k in range(20)]
    df = spark.createDataFrame([(e, k + 100 * f, f, y, 0.0, 1.0, 1.0) for e, k, f, y in rows], "event_type string, k int, is_placebo boolean, t_r double, c_r double, t_s double, c_s double")
    out = {x.event_type: x for x in explain.placebo_trial(df, ["s"], ["k"], perms=200).collect()}
    assert (out["good"].placebo_state, out["bad"].placebo_state) == ("PASSED", "FAILED")
    assert abs(out["good"].att - 0.1) < 1e-9 and out["bad"].att is None and out["bad"].p_value is None
    alone = explain.placebo_trial(df.where("NOT is_placebo"), ["s"], ["k"], perms=50).collect()
    assert {x.placebo_state for x in alone} == {"UNMEASURED"} and all(x.att for x in alone)


def test_triggers_pass_over_bars_without_a_price(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 2, 9, m)
    rows = [("d", 1, at(0), 100.0), ("d", 1, at(1), 0.0), ("d", 1, at(2), 104.0), ("d", 1, at(3), -1.0), ("d", 1, at(4), 100.0), ("d", 2, at(0), 0.0)]
    bars = spark.createDataFrame(rows, "session string, symbol int, ts timestamp, close double")
    base = spark.createDataFrame([("d", 1, 100.0), ("d", 2, 0.0)], "session string, symbol int, base double")
    got = [(x.ts, x.event, x.anchor) for x in minute.price_trigger(bars, base).orderBy("ts").collect()]
    assert got == [(at(2), "FIRE", 104.0), (at(4), "REVERT", 100.0)]


def test_running_sums_meet_across_ranges(spark):
    df = spark.createDataFrame([(float((k * 37) % 1000), 1 + k % 3) for k in range(1000)], "v double, n int")
    got = [x.b for x in stats.running(df, "v", "n", "b").orderBy("v").collect()]
    want, total = [], 0
    for v, n in sorted((x.v, x.n) for x in df.collect()):
        total += n
        want.append(float(total))
    assert got == want
    assert stats.running(df.limit(0), "v", "n", "b").count() == 0


def test_correlations_by_blocks(spark):
    """Blocks of any size give each pair's correlation over its common days; gaps, constants and single days."""
    import numpy as np

    r = np.random.default_rng(2)
    series = {k: {d: float(r.normal()) for d in range(30) if r.random() < 0.7} for k in range(25)}
    series[25], series[26] = {d: 1.5 for d in range(30)}, {3: 1.0}
    df = spark.createDataFrame([(k, d, v) for k, x in series.items() for d, v in x.items()] + [(1, 99, None)], "symbol long, trade_date int, r double").repartition(4)
    want = {}
    for a in series:
        for b in series:
            days = sorted(set(series[a]) & set(series[b]))
            if a < b and len(days) >= 10:
                x, y = ([series[k][d] for d in days] for k in (a, b))
                want[a, b] = (None if len(set(x)) == 1 or len(set(y)) == 1 else round(float(np.corrcoef(x, y)[0, 1]), 9), len(days))
    for block in (512, 7):
        got = {(x.a, x.b): (None if x.rho is None else round(x.rho, 9), x.n) for x in stats.return_correlation(df, 10, block=block).collect()}
        assert got == want
    assert stats.return_correlation(df.limit(0), 10).count() == 0


def test_units_meet_every_window_once(spark):
    """More units than blocks, and a window and a unit that stand twice."""
    t0 = dt.datetime(2024, 1, 2, 9)
    bar = lambda s, k, o, h, lo, c, v: (s, t0 + dt.timedelta(minutes=k), o, h, lo, c, v)
    batch = spark.createDataFrame([bar(0, 0, 1.0, 2.0, 0.5, 1.5, 10.0), bar(1, 0, 1.0, 1.0, 1.0, 1.0, 0.0), bar(2, 1, 1.0, 0.5, 0.5, 1.5, 10.0)], "symbol int, ts timestamp, open double, high double, low double, close double, volume double")
    units = spark.createDataFrame([(k,) for k in [*range(200), 7]], "symbol int")
    windows = spark.createDataFrame([(t0 + dt.timedelta(minutes=k),) for k in (0, 1, 1)], "ts timestamp")
    got = {(r.symbol, r.ts): r.status for r in minute.classify_units(batch, units, windows).collect()}
    want = {(s, t0 + dt.timedelta(minutes=k)): "missing" for s in range(200) for k in (0, 1)}
    want |= {(0, t0): "received", (1, t0): "no_trade", (2, t0 + dt.timedelta(minutes=1)): "invalid"}
    assert got == want
    assert minute.classify_units(batch, units, windows).count() == 400
    assert minute.classify_units(batch, units.limit(0), windows).count() == 0


def test_window_facts_by_hours(spark):
    """Windows within an hour, over several, over hours' ends and outside the day, against each bar and event by itself."""
    r, day = random.Random(3), dt.datetime(2024, 1, 2)
    at = lambda s: day + dt.timedelta(seconds=s)
    bars = [(f, at(s), p, p, p, p + 0.5, 1.0) for f in (1, 2) for s in sorted(r.sample(range(-90_000, 80_000), 60)) for p in [r.uniform(5, 9)]]
    events = [(f, k, at(s)) for f in (1, 2) for k, s in enumerate([*r.sample(range(86_400), 80), 3600, 7200, 7199])]
    windows = [(0, at(3600), at(7200)), (1, at(3599), at(7201)), (2, at(100), at(200)), (3, at(0), at(86_399)), (4, at(5000), at(60_000)), (5, at(-7200), at(-3600)), (6, at(9000), at(8000))]
    df = spark.createDataFrame(bars, "fund int, ts timestamp, open double, high double, low double, close double, volume double")
    layers = spark.createDataFrame([(1, 0.1, 0.2, 0.3)], "fund int, market double, sector double, idio double")
    members = spark.createDataFrame([(1, 5, 0.1, 0.2)], "fund int, constituent int, contribution double, r double")
    e = spark.createDataFrame(events, "fund int, event_id int, event_time timestamp")
    w = spark.createDataFrame(windows, "window_id int, w_start timestamp, w_end timestamp")
    df = df.withColumn("trade_date", F.to_date("ts"))
    rows = explain.window_facts(df, layers, members, e, w, day.date()).where("error IS NULL").collect()
    assert {x.window_id for x in rows} >= {3, 4}
    for x in rows:
        _, a, b = windows[x.window_id]
        inside = [k for f, k, s in events if f == x.fund and a <= s <= b]
        assert x.n_events == len(inside) and x.first_event == (min(inside) if inside else None)
        own = sorted((s, o, c) for f, s, o, *_, c, _ in bars if f == x.fund)
        before = [c for s, _, c in own if s < day][-1]
        until = [c for s, _, c in own if day <= s < b][-1]
        assert math.isclose(x.header_return, math.log(until / before), rel_tol=1e-9)
