"""Links and what they pass on: by blocks and words of days, without a row for each source's event."""

import datetime as dt
import random

from marketlens import plans, registry  # noqa: F401
from marketlens.operators import events as V
from marketlens.plans import events_q

D0 = dt.date(2023, 12, 1)


def _drawn(n, names, days, seed):
    draw = random.Random(seed)
    return [(draw.choice(names), draw.choice(names), "L", D0 + dt.timedelta(draw.randrange(days))) for _ in range(n)]


def test_spillover_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 40)
    monkeypatch.setattr(V, "STEP", 8)
    names = [f"n{i}" for i in range(30)]
    links = _drawn(200, names, 150, 1) + [("n0", "n0", "L", D0), ("n1", None, "L", D0), ("n2", "n3", "M", D0)]
    events = [(a, d, "R") for a, _, _, d in _drawn(120, names, 200, 2)] + [("n4", D0, "N"), ("n5", None, "R")]
    hit = {(a, d) for a, d, k in events if k == "R" and d}
    both = [(a, b, t) for a, b, k, t in links if k == "L" and b] + [(b, a, t) for a, b, k, t in links if k == "L" and b]
    want = {(b, d) for a, b, t in both for x, d in hit if x == a and t <= d} - hit
    out = V.spillover_treated(spark.createDataFrame(events, "entity_id string, d date, event_type string"), spark.createDataFrame(links, "src string, dst string, link_type string, link_date date"), "R", "L")
    rows = [tuple(r) for r in out.select("entity_id", "d").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_spillover_tells_of_a_cell_in_parts(spark, monkeypatch):
    """Links that come in many pieces, and what they give told before a cell is done, add up; a link may stand often."""
    monkeypatch.setattr(V, "LINKS", 16, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_spillover_in_blocks(spark, monkeypatch)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_undirected_links_are_those_of_both_ways(spark):
    """Two entities of an event stand once; the first date of each pair is that of both ways together."""
    draw = random.Random(6)
    rows = [(draw.randrange(40), draw.choice(["s", "s", "p"]), draw.randrange(25), D0 + dt.timedelta(draw.randrange(60)) if draw.random() < 0.9 else None) for _ in range(400)] + [(1, "s", None, D0)]
    args = spark.createDataFrame(rows, "event_id long, role string, entity_id long, link_date date")
    rules = [("s", "s", "L")]
    both = V._first_links(V.link_edges(args, rules), "L", "link_date")
    own = V.link_edges(args, rules, undirected=True)
    assert own.where("src >= dst").count() == 0 and own.count() < V.link_edges(args, rules, distinct=False).count()
    assert {tuple(r) for r in V._first_links(own, "L", "link_date").collect()} == {tuple(r) for r in both.collect()}


def test_spillover_does_not_make_pairs_distinct(spark, sf):
    """Pairs of an event go once to the cell that passes days along them: no shuffle of pairs before that."""
    plan = registry.QUERIES["spillover_treated"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan[plan.index("MapInArrow") :]
    assert "CoGroup" not in plan and "Aggregate" not in pairs.split("Join")[0] and "src" in pairs


def test_spillover_without_links_or_events(spark):
    events = spark.createDataFrame([("a", D0, "R")], "entity_id string, d date, event_type string")
    links = spark.createDataFrame([("a", "b", "L", D0)], "src string, dst string, link_type string, link_date date")
    assert V.spillover_treated(events, links.where("false"), "R", "L").count() == 0
    assert V.spillover_treated(events.where("false"), links, "R", "L").count() == 0


def test_indicator_either_way_and_without_ends(spark):
    links = spark.createDataFrame([(5, 2, "L", D0), (7, None, "L", D0), (2, 5, "L", D0 + dt.timedelta(9))], "src long, dst long, link_type string, link_date date")
    pairs = spark.createDataFrame([(2, 5, D0), (5, 2, D0 - dt.timedelta(1)), (None, 7, D0), (7, 7, D0)], "x long, y long, d date")
    found = {(r.x, r.y): r.linked for r in V.link_indicator(pairs, links, "L").collect()}
    assert found == {(2, 5): True, (5, 2): False, (None, 7): False, (7, 7): False}


def test_pairs_are_made_distinct_before_they_meet(spark, sf):
    plan = events_q._pairs(spark, sf)._jdf.queryExecution().optimizedPlan()
    assert "Aggregate" not in plan.toString().split("Join")[0]


def test_union_both_ways_shuffles_once(spark):
    rows = [(1, 2, "L"), (2, 1, "L"), (1, 2, "L"), (3, 3, "L"), (None, 4, "L"), (5, None, "L"), (None, None, "L"), (1, 2, "M")]
    out = V.union_distinct_pairs(spark.createDataFrame(rows, "src long, dst long, link_type string"))
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == {*rows, *((b, a, k) for a, b, k in rows)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
