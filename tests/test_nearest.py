"""Nearest controls against all pairs."""

import random

import pytest

from marketlens.operators import events as V


@pytest.mark.parametrize("flat", [False, True])
def test_nearest_controls(spark, monkeypatch, flat):
    monkeypatch.setattr(V, "LOOK", 2)
    monkeypatch.setattr(V, "AT_ONCE", 64)
    draw = random.Random(3)
    one = lambda: 1.0 if flat else draw.choice([draw.uniform(-2, 2), 0.5, 1.0])
    row = lambda i: (f"u{i:03d}", draw.choice("ab"), one(), float(draw.randrange(60)))
    treated = [row(i) for i in range(60)] + [("n", "a", None, 1.0), ("m", "a", float("nan"), 1.0), ("z", None, 1.0, 1.0)]
    pool = [row(i) for i in range(30, 260)] + [("y", None, 1.0, 1.0), (None, "a", 1.0, 1.0), ("i", "a", float("inf"), 1.0)]
    want = set()
    for u, g, x, y in treated:
        if x is None or x != x or g is None:
            continue
        near = [(abs(x - x2) / 0.5 + abs(y - y2) / 7.0, v) for v, g2, x2, y2 in pool if v and g2 == g and v != u and abs(x - x2) <= 0.5 and abs(y - y2) <= 7.0]
        want |= {(g, u, v, d, r) for r, (d, v) in enumerate(sorted(near)[:3], 1)}
    schema = "symbol string, g string, size double, close double"
    out = V.caliper_match(spark.createDataFrame(treated, schema), spark.createDataFrame(pool, schema), ["g"], {"size": 0.5, "close": 7.0}, 3)
    assert out.columns == ["g", "t_symbol", "t_size", "t_close", "c_symbol", "c_size", "c_close", "distance", "rank"]
    assert {(r.g, r.t_symbol, r.c_symbol, r.distance, r["rank"]) for r in out.collect()} == want
