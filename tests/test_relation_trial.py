"""A trial of related instruments from sums against the same over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from marketlens import registry
from marketlens.operators import events, exact, explain
from marketlens.plans import explain_q


def test_sums_give_what_the_panel_gives(spark, monkeypatch):
    draw = random.Random(7)
    rows = [(s, d, draw.gauss(0, 1) if draw.random() < 0.95 else None, float(draw.randrange(9)) if draw.random() < 0.9 else None) for s in range(60) for d in range(6)]
    panel = spark.createDataFrame(rows, "symbol long, trade_date int, ar double, close double")
    e = spark.createDataFrame([(draw.randrange(70), draw.randrange(7), draw.choice("abc")) for _ in range(90)] + [(3, 2, "a"), (3, 2, "a"), (5, 1, "rare")], "symbol long, trade_date int, event_type string")
    edges = spark.createDataFrame([(draw.randrange(60), draw.randrange(60), draw.randrange(5)) for _ in range(150)] + [(4, 4, 0)], "src long, dst long, link_date int")
    pairs = events.relation_panel(panel, e, edges, take=["event_type"])
    names = ["event_type", "n", "n_linked", "p_value", "verdict", F.round("linked_mean", 9).alias("l"), F.round("other_mean", 9).alias("o")]
    for conditions in ([], [("close", ">=", 0.3)], [("close", ">=", 0.2), ("close", "<=", 0.85)]):
        want = sorted(tuple(r) for r in explain.relation_test(pairs, "ar", conditions, perms=20).select(*names).collect())
        got = sorted(tuple(r) for r in explain.relation_trial(panel, e, edges, "ar", conditions, perms=20).select(*names).collect())
        assert got == want and len(got) == 4


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(1)
    v, w, g = rng.integers(0, 50, 400) / 4, rng.integers(1, 9, 400), rng.integers(0, 3, 400)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, v, w, strict=True)], "g int, v double, w long").repartition(5)
    for share in (0.0, 0.2, 0.77, 1.0):
        got = {r.g: r.q for r in exact.weighted_quantile(df, ["g"], "v", share, "w", "q").collect()}
        assert all(abs(got[k] - np.quantile(np.repeat(v[g == k], w[g == k]), share)) < 1e-9 for k in range(3))


def test_query_makes_no_panel(spark, sf, monkeypatch):
    monkeypatch.delattr(explain_q.V, "relation_panel")
    registry.QUERIES["relation_test"](spark, sf).collect()
