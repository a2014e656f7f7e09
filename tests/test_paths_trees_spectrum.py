"""Slopes, clusters, spectra, overlaps and local levels against plain versions of them."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens import plans, registry  # noqa: F401
from marketlens.operators import funds, slopes, spectrum, stats, trees
from marketlens.plans import bindings


def plain_filter(y, x, b, p, q, h):
    out = []
    for yt, xt in zip(y, x, strict=True):
        p = p + q * np.eye(len(b))
        gain = p @ xt / (xt @ p @ xt + h)
        b, p = b + gain * (yt - xt @ b), (np.eye(len(b)) - np.outer(gain, xt)) @ p
        out.append(np.concatenate([b, np.diag(p)]))
    return np.array(out)


@pytest.fixture(scope="module")
def paths():
    """One path of a third of all rows and more, short ones, and what each row's filter gives."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for key, n in [("a", 3), ("hot", 900), ("m", 1), ("z", 40), *((f"k{i}", 25) for i in range(20))]:
        x, b0, p0, q, h = rng.normal(size=(n, 2)), rng.normal(size=2), rng.uniform(0.1, 1, 2), rng.uniform(0.001, 0.1), rng.uniform(0.05, 0.5)
        y = x @ np.array([0.5, -1.0]) + rng.normal(size=n) / 3
        found = plain_filter(y, x, b0, np.diag(p0), q, h)
        for t in range(n):
            rows.append((key, t, float(y[t]), *map(float, x[t]), float(q), float(h), *map(float, b0), *map(float, p0), "kept"))
            want[key, t] = found[t]
    rng.shuffle(rows)
    return [(r[0], int(r[1]), *map(float, r[2:11]), r[11]) for r in rows], want


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_slopes_over_ranges(spark, paths, ranges):
    rows, want = paths
    df = spark.createDataFrame(rows, "k string, t int, y double, u double, v double, q double, h double, b0_u double, b0_v double, p0_u double, p0_v double, note string")
    df = df.union(df.where("t = 1 AND k = 'z'").withColumn("t", F.lit(None).cast("int")))  # a row without a place is left out
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = slopes.slope_paths(df, ["u", "v"], ["k"], "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(got) == len(want) and all(r.note == "kept" and r.nth == r.t + 1 for r in got)
    for r in got:
        assert np.allclose([r.beta_u, r.beta_v, r.var_u, r.var_v], want[r.k, r.t], atol=1e-9)


def test_slopes_of_nothing(spark):
    df = spark.createDataFrame([], "symbol string, trade_date int, y double, x double")
    assert slopes.kalman_beta(df, 0.1, 0.1).collect() == []


def test_kalman_follows_a_constant_slope(spark):
    r = spark.range(300).select(F.lit("s").alias("symbol"), F.col("id").alias("t"), F.sin(F.col("id")).alias("x")).withColumn("y", 0.7 * F.col("x"))
    last = slopes.kalman_beta(r, 1e-6, 0.01, order="t").orderBy(F.desc("t")).first()
    assert abs(last.beta - 0.7) < 0.01


def test_two_factors_start_from_the_session_before(spark):
    rng, rows = np.random.default_rng(5), []
    market, sector = rng.normal(size=(3, 30)), rng.normal(size=(3, 30))
    sector = sector + 0.6 * market
    y = 1.2 * market + 0.4 * sector + rng.normal(size=(3, 30)) / 10
    for d in range(3):
        rows += [("s", dt.date(2024, 1, d + 1), t, float(y[d, t]), float(market[d, t]), float(sector[d, t])) for t in range(30)]
    df = spark.createDataFrame(rows, "symbol string, session date, ts int, y double, market double, sector double")
    variances = spark.createDataFrame([("s", dt.date(2024, 1, d), 0.5, 0.02) for d in (1, 2, 3)], "symbol string, session date, q double, h double")
    priors = slopes.session_priors(df, variances, 10)
    assert {r.session.day for r in priors.collect()} == {2, 3}
    paths = slopes.two_factor_beta(df, priors)
    got = {r.session.day: r for r in slopes.path_contributions(paths).collect()}
    for d in (1, 2):  # days 2 and 3, from days 1 and 2
        gamma = sector[d - 1] @ market[d - 1] / (market[d - 1] @ market[d - 1])
        before = np.stack([market[d - 1], sector[d - 1] - gamma * market[d - 1]], 1)
        b0, left = np.linalg.lstsq(before, y[d - 1], rcond=None)[:2]
        p0 = left[0] / 28 * np.linalg.inv(before.T @ before)
        vm = np.var(market[d - 1], ddof=1)
        h = max(0.5 - b0[0] ** 2 * vm, 0.05) + 0.04
        x = np.stack([market[d], sector[d] - gamma * market[d]], 1)
        want = plain_filter(y[d], x, b0, p0, h / (vm * 900), h)
        r = got[d + 1]
        assert np.allclose([r.market_contribution, r.sector_contribution], (want[:, :2] * x).sum(0), atol=1e-9)
        assert np.allclose([r.market_ci, r.sector_ci], 1.96 * np.sqrt((want[:, 2:] * x**2).sum(0)), atol=1e-9)
        assert np.allclose(r.market_quarters, [c.mean() for c in np.array_split(want[:, 0], 4)], atol=1e-9)  # 8, 8, 7, 7


def single_linkage(n, d, k):
    """By the definition: the two nearest clusters are joined until k are left."""
    own = {i: {i} for i in range(n)}
    for _, a, b in sorted((v, a, b) for (a, b), v in d.items()):
        if len({id(s) for s in own.values()}) <= k:
            break
        if own[a] is not own[b]:
            own[a] |= own[b]
            for i in own[b]:
                own[i] = own[a]
    return {i: min(s) for i, s in own.items()}


@pytest.mark.parametrize("k", [1, 40])
def test_clusters_are_single_linkage(spark, k):
    rng = np.random.default_rng(k)
    at = np.concatenate([rng.normal(c, 0.3, (20, 2)) for c in range(10)])
    rho = {(a, b): round(float(1 - np.linalg.norm(at[a] - at[b])), 2) for a in range(200) for b in range(a + 1, 200)}  # with ties
    got = {r.id: r.cluster for r in trees.correlation_clusters(spark.createDataFrame([(a, b, v) for (a, b), v in rho.items()], "a long, b long, rho double"), k, 1).collect()}
    assert got == single_linkage(200, {p: 1 - v for p, v in rho.items()}, k)


def test_clusters_recover_planted_groups(spark):
    e = [(a, b, 0.9 if a // 5 == b // 5 else 0.01) for a in range(10) for b in range(a + 1, 10)]
    e += [(3, 77, 0.0), (5, 88, None)]
    got = {r.id: r.cluster for r in trees.correlation_clusters(spark.createDataFrame(e, "a long, b long, rho double"), 4, 2).collect()}
    assert got == {**{k: 0 for k in range(5)}, **{k: 5 for k in range(5, 10)}, 77: None, 88: None}
    assert trees.correlation_clusters(spark.createDataFrame([], "a long, b long, rho double"), 2, 1).collect() == []


def test_a_long_chain_is_one_tree(spark):
    e = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.col("id").cast("double").alias("d"))
    tree, labels = trees.minimum_tree(spark.range(101), e)
    assert tree.count() == 100 and labels.select("label").distinct().count() == 1


def test_spectrum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 90)) + np.outer(rng.normal(size=300), np.ones(90)) * 0.5
    x[:, 7] = 3.0  # a name that doesn't vary
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [(None,), ([float("nan")] * 90,)], "features array<double>")
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    want = np.sort(np.linalg.eigvalsh(z.T @ z / 300))[::-1]
    got = spectrum.spectrum_noise(df, 6).orderBy("nth").collect()
    assert np.allclose([r.eigenvalue for r in got], want[:6], atol=1e-6)
    assert got[0].is_signal and not got[5].is_signal and abs(got[0].noise_bound - (1 + np.sqrt(90 / 300)) ** 2) < 1e-12
    s = spectrum.shrinkage(df).first()
    cov, mu = z.T @ z / 300, np.trace(z.T @ z / 300) / 90
    gap = ((cov - mu * np.eye(90)) ** 2).sum()
    noise = sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / 300**2
    assert abs(s.shrinkage - min(noise, gap) / gap) < 1e-9
    assert abs(s.raw - (cov[~np.eye(90, dtype=bool)] ** 2).mean()) < 1e-9
    assert spectrum.spectrum_noise(df.limit(0), 3).collect() == spectrum.shrinkage(df.limit(0)).collect() == []


@pytest.mark.parametrize("least", [0.0, 0.05, 0.3, 0.9])
def test_overlaps_above_a_bound(spark, least):
    rng, rows = np.random.default_rng(9), []
    for f in range(40):
        members = [0, *rng.choice(np.arange(1, 60), rng.integers(1, 15), replace=False)]  # all hold member 0
        w = rng.dirichlet(np.ones(len(members)))
        rows += [(f, int(m), float(v)) for m, v in zip(members, w, strict=True)]
    rows += [(40 + i, m, v) for i in (0, 1) for f, m, v in rows if f == 3]  # twins
    own = {}
    for f, m, v in rows:
        own.setdefault(f, {})[m] = v
    want = {(a, b): sum(min(own[a][m], own[b][m]) for m in own[a].keys() & own[b].keys()) for a in own for b in own if a < b}
    got = {(r.fund_a, r.fund_b): r.overlap for r in funds.portfolio_overlap(spark.createDataFrame(rows, "fund int, constituent int, weight double"), least=least).collect()}
    assert got.keys() == {p for p, v in want.items() if v >= least and v > 0}
    assert all(abs(v - want[p]) < 1e-9 for p, v in got.items())


def test_local_level_by_joint_normals(spark):
    """Each round's smoothed moments by plain conditioning of a joint normal distribution."""
    y = np.log(np.array([10.0, 10.2, 10.1, 10.6, 10.4, 10.9, 11.0, 10.7]))
    n = len(y)
    q = h = max(float(np.var(np.diff(y))) / 2, 1e-10)
    for _ in range(4):
        prior = q * np.minimum.outer(np.arange(n), np.arange(n)) + h  # the first level: N(y[0], h)
        gain = prior @ np.linalg.inv(prior + h * np.eye(n))
        mean, cov = y[0] + gain @ (y - y[0]), prior - gain @ prior
        v, c = np.diag(cov), np.diag(cov, 1)
        q, h = np.mean(np.diff(mean) ** 2 + v[1:] + v[:-1] - 2 * c), np.mean((y - mean) ** 2 + v)
    rows = spark.createDataFrame([("s", 1, t, float(np.exp(v))) for t, v in enumerate(y)], "symbol string, trade_date int, ts int, close double")
    got = stats.local_level_em(rows, rounds=4).first()
    assert np.allclose([got.q, got.h], [q, h], rtol=1e-9)


def test_sector_slopes_start_from_fitted_variances(spark, sf, monkeypatch):
    """The query's variances are those that EM fits, not where it starts."""
    told = []
    monkeypatch.setattr(slopes, "session_priors", lambda rows, variances, *a, real=slopes.session_priors: told.append(variances) or real(rows, variances, *a))
    registry.QUERIES["kalman_beta_sector"](spark, sf)
    closes = {}
    for r in bindings.prices(spark, sf).where("close > 0").orderBy("trade_date").collect():
        closes.setdefault((r.symbol, r.trade_date - dt.timedelta(r.trade_date.weekday())), []).append(math.log(r.close))
    found = {(r.symbol, r.session): r for r in told[0].collect()}
    assert found.keys() == closes.keys() and max(len(y) for y in closes.values()) > 3
    for at, y in closes.items():
        r, n, y = found[at], len(y), np.array(y)
        assert r.n == n
        if n <= 2:
            assert r.q is None or math.isnan(r.q)
            continue
        q = h = max(float(np.var(np.diff(y))) / 2, 1e-10)
        for _ in range(20):
            prior = q * np.minimum.outer(np.arange(n), np.arange(n)) + h
            gain = prior @ np.linalg.inv(prior + h * np.eye(n))
            mean, cov = y[0] + gain @ (y - y[0]), prior - gain @ prior
            v, c = np.diag(cov), np.diag(cov, 1)
            q, h = np.mean(np.diff(mean) ** 2 + v[1:] + v[:-1] - 2 * c), np.mean((y - mean) ** 2 + v)
        assert np.allclose([r.q, r.h], [q, h], rtol=1e-6)
