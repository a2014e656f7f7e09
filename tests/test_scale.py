"""Steps that a query's growth hangs on: they keep to what is needed, and give what the plain form gives."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from marketlens.operators import events, exact, stats, trees
from marketlens.plans import bindings


def test_spanning_correlations_hold_every_forest(spark):
    """Blocks keep fewer rows than keys, with ties, keys that don't vary and keys with too few days; clusters are those of all pairs."""
    rng = np.random.default_rng(5)
    shape = rng.integers(0, 3, (12, 9)).astype(float)
    rows = [(f"k{k}", d, float(shape[k % 12, d]) if k % 7 else 1.0) for k in range(60) for d in range(9) if rng.random() < (0.95 if k % 11 else 0.2)]
    df = spark.createDataFrame(rows, "symbol string, trade_date int, r double")
    full = stats.return_correlation(df, 4, block=16)
    some = stats.spanning_correlations(df, 4, block=16)
    assert some.count() < full.count() / 2
    assert some.select("a", "b", "n").exceptAll(full.select("a", "b", "n")).where("n > 0").distinct().join(full, ["a", "b"], "left_anti").count() == 0
    for k, least in ((1, 1), (4, 1), (9, 2)):
        want, got = ({tuple(r) for r in trees.correlation_clusters(c, k, least).collect()} for c in (full, some))
        assert got == want


def test_correlations_send_keys_a_bounded_number_of_times(spark, monkeypatch):
    """Keys go in PARTS, however many blocks they make; what comes out is what one block gives. One day of many keys is missing, or none."""
    monkeypatch.setattr(stats, "PARTS", 3, raising=False)
    rng = np.random.default_rng(8)
    shape = rng.integers(0, 4, (14, 9)).astype(float)
    for share in (0.9, 1.0):
        rows = [(f"k{k}", d, float(shape[k % 14, d]) + (k // 70) * (d % 2) if k % 9 else 2.0) for k in range(150) for d in range(9) if rng.random() < share]
        df = spark.createDataFrame(rows, "symbol string, trade_date int, r double")
        full = {(r.a, r.b): (r.rho and round(r.rho, 9), r.n) for r in stats.return_correlation(df, 4).collect()}
        out = stats.return_correlation(df, 4, block=4)
        assert ", 42), 3)" in out._jdf.queryExecution().optimizedPlan().toString()
        got = out.collect()
        assert len(got) == len(full) and {(r.a, r.b): (r.rho and round(r.rho, 9), r.n) for r in got} == full
        some = stats.spanning_correlations(df, 4, block=4)
        assert ", 42), 3)" in some._jdf.queryExecution().optimizedPlan().toString()
        own = some.collect()
        assert len(own) <= 3 * 150 + 6 * 40 and all(full[r.a, r.b] == (r.rho and round(r.rho, 9), r.n) for r in own)
        for k, least in ((6, 2),):
            want, found = ({tuple(r) for r in trees.correlation_clusters(spark.createDataFrame([(a, b, rho) for (a, b), rho in c], "a string, b string, rho double"), k, least).collect()} for c in (((x, v[0]) for x, v in full.items()), (((r.a, r.b), r.rho and round(r.rho, 9)) for r in own)))
            assert found == want
    keys = stats.return_correlation(spark.createDataFrame([("a", d, d * 1.0) for d in range(5)] + [("b", d, d % 2 * 1.0) for d in range(5)], "symbol string, trade_date int, r double"), 4, block=1)
    assert [(r.a, r.b, r.n) for r in keys.collect()] == [("a", "b", 5)]


def test_holdings_join_lines_once(spark, sf):
    """What reads holdings, however often, doesn't read lines or orders again."""
    assert not [f for f in bindings.holdings(spark, sf).inputFiles() if "lineitem" in f or "orders" in f]


def _least(rows, k, draw, seed):
    def x(key):
        h = hashlib.md5(f"{seed}|{(draw - 1) // 4}|{key}".encode()).hexdigest()
        return h[(draw - 1) % 4 * 8 :][:8]

    return sum(y for _, y in sorted((x(key) + key, y) for key, y in rows)[:k])


def test_rare_labels_are_drawn_below_a_bound(spark):
    """Of a large stratum with few labels only what can be labelled is ordered; draws that find too few below the bound look at all."""
    rows = [("s", f"k{i}", float(i % 37)) for i in range(900)]
    df = spark.createDataFrame([("g", s, 900, 6, key, y) for s, key, y in rows], "g string, s string, _n long, _k long, _key string, _y double").repartition(3)
    want = {p: _least([(key, y) for _, key, y in rows], 6, p, 3) for p in range(1, 11)}
    assert {r._p: r._s for r in exact.drawn_sums(df, ["g"], "s", 10, 3, 50).collect()} == want
    sizes = df.groupBy("g", "s").agg(F.first("_k").alias("_k"), F.first("_n").alias("_n"))
    for share in (0.3, 0.006, 0.0):
        got = exact._below(df, sizes, F.lit(share), ["g"], "s", 10, 3, 50).groupBy("_p").agg(F.sum("_s").alias("_s"))
        assert {r._p: r._s for r in got.collect()} == want


def test_relation_panel_takes_links_along(spark):
    """Links go with the event, either way round and from their date on; events of two types on a day count twice."""
    panel = spark.createDataFrame([(s, d) for s in range(40) for d in (1, 2)], "symbol long, trade_date int")
    e = spark.createDataFrame([(3, 1, "a"), (3, 1, "b"), (3, 2, "a"), (7, 2, "a"), (3, 2, "a")], "symbol long, trade_date int, event_type string")
    edges = [(3, 4, 1), (9, 3, 2), (3, 9, 5), (7, 7, 1), (5, 7, 3), *((7, k, 2) for k in range(10, 30))]
    got = events.relation_panel(panel, e, spark.createDataFrame(edges, "src long, dst long, link_date int"), take=["event_type"])
    first = {}
    for a, b, t in edges:
        first[frozenset((a, b))] = min(t, first.get(frozenset((a, b)), t))
    want = [(x, d, t, y, first.get(frozenset((x, y)), 9) <= d) for x, d, t in {tuple(r) for r in e.collect()} for y in range(40) if y != x]
    assert sorted(tuple(r) for r in got.select("x", "d", "event_type", "y", "linked").collect()) == sorted(want)
