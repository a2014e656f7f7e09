"""Exact order statistics and draws, forced through every pass, against Spark's own percentile and against sorted strata."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import exact, stats


def values(spark):
    r = random.Random(4)
    kinds = {"normal": lambda k: r.gauss(0, 1), "tied": lambda k: float(r.choice([1, 1, 1, 2, 3])), "one": lambda k: 5.0, "powers": lambda k: 2.0 ** -(k % 900), "two": lambda k: float(k % 2), "int": lambda k: float(k)}
    rows = [(g, f(k), -f(k)) for g, f in kinds.items() for k in range(3000)] + [("few", float(k), None) for k in range(3)] + [("nulls", None, None)]
    return spark.createDataFrame(rows, "g string, v double, u double").repartition(5)


@pytest.mark.parametrize("small", [10**6, 700, 3])
def test_quantiles(spark, small, monkeypatch):
    monkeypatch.setattr(exact, "ACCURACY", 50)  # a poor sketch costs passes only
    df, shares = values(spark), [0.0, 0.025, 0.5, 0.8, 1.0]
    got = {r.g: tuple(r)[1:] for r in exact.quantiles(df, ["g"], [(f"q{k}", "v", s) for k, s in enumerate(shares)] + [("w", "u", 0.3)], small).collect()}
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(s)).alias(f"q{k}") for k, s in enumerate(shares)], F.percentile("u", F.lit(0.3)).alias("w")).where("g <> 'nulls'").collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert [x for x in got[g] if x is not None] == pytest.approx([x for x in want[g] if x is not None], rel=1e-12, abs=1e-12)
        assert [x is None for x in got[g]] == [x is None for x in want[g]]


@pytest.mark.parametrize("most", [4096, 40, 2])
def test_draws(spark, most):
    """Small and large strata, ties of the hash's digits included: keys that repeat are told apart by nothing, but have one value."""
    r = random.Random(2)
    rows = [("a", s, n, min(k, n - 1), f"{s}|{j}", r.gauss(0, 1)) for s, n, k in (("x", 500, 100), ("y", 30, 29), ("z", 7, 1)) for j in range(n)]
    rows += [("b", "w", 100, 60, "same", 2.0)] * 100
    got = {(x.g, x._p): x._s for x in exact.drawn_sums(spark.createDataFrame(rows, "g string, s string, _n long, _k long, _key string, _y double").repartition(4), ["g"], "s", 9, 3, most).collect()}
    want = {}
    for p in range(1, 10):
        for s in "xyzw":
            own = [x for x in rows if x[1] == s]
            digit = lambda x: hashlib.md5(f"3|{(p - 1) // 4}|{x[4]}".encode()).hexdigest()[(p - 1) % 4 * 8 :][:8]  # noqa: B023, E731
            g = (own[0][0], p)
            want[g] = want.get(g, 0) + sum(x[5] for x in sorted(own, key=lambda x: (digit(x), x[4]))[: own[0][3]])
    assert got == pytest.approx(want)


def test_no_draw_is_sorted(spark):
    """What is shuffled doesn't grow with the draws, and no window goes over them."""
    rows = spark.range(100).selectExpr("'a' AS event_type", "id % 4 AS st", "id", "cast(id % 3 = 0 AS int) AS d", "cast(id AS double) AS y")
    plan = stats.stratified_permutation(rows, "d", "y", "st", ["id"], perms=10)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_ranks_over_ranges(spark):
    r = random.Random(8)
    means = [r.uniform(0, 30) for _ in range(300)]
    rows = [(f"n{k:03d}", m + d) for k, m in enumerate(means) for d in (-r.random(), 0.0, r.random())]
    df = spark.createDataFrame(rows, "name string, value double")
    g = df.groupBy("name").agg(F.avg("value").alias("m"), F.percentile("value", F.lit(0.025)).alias("l"), F.percentile("value", F.lit(0.975)).alias("h")).collect()
    want, rank, head = {}, 0, None
    for k, x in enumerate(sorted(g, key=lambda x: (-x.m, x.name)), 1):
        if head is None or x.h < head:
            rank, head = k, x.l
        want[x.name] = rank
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    assert {x.name: x["rank"] for x in stats.rank_with_ties(df).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert stats.rank_with_ties(df.where("false")).collect() == []


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact_", [True, False])
def test_as_of_joins_of_hot_keys(spark, forward, exact_):
    """A key cut into segments of time gives what it gives whole, and its rows go to many tasks."""
    from marketlens.operators import pit

    r = random.Random(9)
    key = lambda: r.choice(["hot"] * 8 + ["warm", "cold", None])
    left = spark.createDataFrame([(k, key(), r.choice([None, *range(300)])) for k in range(900)], "id long, k string, t long").repartition(3)
    right = spark.createDataFrame([(key(), r.randint(-20, 320), r.choice([None, "x", "y"])) for _ in range(150)] + [("hot", 100, "z")] * 40, "k string, u long, v string").repartition(3)
    found = {hot: [tuple(x) for x in pit.asof_join(left, right, ["k"], "t", "u", ["u", "v"], exact=exact_, forward=forward, hot=hot).collect()] for hot in (10**6, 5)}
    key = lambda x: tuple(map(str, x))
    assert sorted(found[5], key=key) == sorted(found[10**6], key=key) and any(x[3] is not None for x in found[5])
    plan = pit.asof_join(left, right, ["k"], "t", "u", ["u", "v"], hot=5)._jdf.queryExecution().toString()
    assert "_seg" in plan
