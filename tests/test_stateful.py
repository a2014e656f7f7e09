"""Streams with state: any order of arrival gives the batch's result, state is given up in time, and timers fire once."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from marketlens.operators import mentions
from marketlens.operators.events import novelty
from marketlens.streaming import minute, stateful

START = dt.datetime(2024, 1, 1)
STAGES = {"a": 1, "b": 2}


def run(spark, folder, stream_of, parts, schema):
    """stream_of over the parts (lists of rows), a run after each, so that they come in that order; what it said."""
    path = f"{folder}/{uuid.uuid4().hex}"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = stream_of(spark.readStream.schema(schema).parquet(f"{path}/in"))
        with stateful.rocksdb(spark):
            minute.run_available(out, path)
    return spark.read.schema(out.schema).parquet(f"{path}/data")


def observations(seed, n):
    r = random.Random(seed)
    rows, seen = [], 0
    for k in range(n):
        seen += r.choice([0, 1, 1, 2])
        rows.append((k % 7, r.randint(0, 1), max(0, seen - r.choice([0, 0, 0, 5])), r.choice([None, None, None, "u1", "u2"]), START + dt.timedelta(minutes=k), k))
    return rows


ITEM = "item_id long, hash long, seen long, url_id string, ts timestamp, seq long"
SAID = ["item_id", "seq", "observation", "promoted", "generation", "article_id"]


def test_observations_in_any_order(spark, tmp_path):
    rows = observations(1, 150)
    want = sorted(tuple(x) for x in minute.news_observe(spark.createDataFrame(rows, ITEM)).select(SAID).collect())
    assert {x[2] for x in want} == {"NEW", "UNCHANGED", "CONTENT_CHANGED", "ID_PROMOTED", "STALE", "IDENTITY_CONFLICT", "CHECKSUM_CONFLICT"}
    state, plain = {}, []
    for row in rows:
        state[row[0]], said = stateful.observe(state.get(row[0]), dict(zip(("item_id", "hash", "seen", "url_id"), row, strict=False)))
        plain.append((row[0], row[5], *(said[c] for c in SAID[2:])))
    assert sorted(plain) == want
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    # The second part holds rows of the first again: they change nothing.
    said = run(spark, tmp_path, lambda s: stateful.stream_news_observe(s, "1 day"), [mixed[:60], mixed[40:100], mixed[100:]], ITEM)
    assert said.groupBy("item_id", "seq", "revision").count().where("count > 1").count() == 0
    assert said.agg(F.max("revision")).first()[0] > 1
    assert sorted(tuple(x) for x in stateful.last_revisions(said, ["item_id", "seq"]).select(SAID).collect()) == want


def test_rows_in_order_are_folded_away(spark, tmp_path):
    """With a short watermark, rows that come in order give the same, each said once; rows behind the watermark count no more."""
    rows = observations(3, 120)
    want = sorted(tuple(x) for x in minute.news_observe(spark.createDataFrame(rows, ITEM)).select(SAID).collect())
    late = (0, 9, 999, None, START - dt.timedelta(days=1), 1000)
    said = run(spark, tmp_path, lambda s: stateful.stream_news_observe(s, "5 minutes"), [rows[:40], rows[40:80], [*rows[80:], late]], ITEM)
    assert sorted(tuple(x) for x in said.select(SAID).collect()) == want and said.where("revision > 1").count() == 0


def test_threads(spark, tmp_path):
    schema, r = "event_id long, user_id long, topic long, stage string, is_correction boolean, ts timestamp", random.Random(6)
    rows = [(k, k % 2, r.choice([0, 1, None]), r.choice(["a", "b", "c"]), r.random() < 0.2, START + dt.timedelta(hours=k // 2)) for k in range(80)]
    want = {x.event_id: x.novelty for x in novelty(spark.createDataFrame(rows, schema).where("topic IS NOT NULL"), ["user_id", "topic"], STAGES).collect()}
    r.shuffle(rows)
    said = run(spark, tmp_path, lambda s: stateful.stream_thread_events(s, ["user_id", "topic"], STAGES, "30 days"), [rows[:30], rows[30:]], schema)
    got = stateful.last_revisions(said, ["user_id", "topic", "event_id"]).collect()
    assert {x.event_id: x.novelty for x in got} == want
    own = {}
    for k, user, topic, stage, _, ts in sorted(rows):
        if topic is not None:
            n, best, opened = own.get((user, topic), (0, None, ts))
            best = stage if STAGES.get(stage, 0) > STAGES.get(best, 0) else best
            own[user, topic] = (n + 1, best, opened)
            x = next(x for x in got if x.event_id == k)
            assert (x.prior_count, x.current_stage, x.opened_at) == (n, best, int((opened - dt.datetime(1970, 1, 1)).total_seconds() * 10**6))


def test_a_thread_ends(spark, tmp_path):
    """After a day without events a thread's state goes; the next event is the first of another."""
    schema = "event_id long, user_id long, topic long, stage string, is_correction boolean, ts timestamp"
    at = lambda k, user, day: (k, user, 0, "a", False, START + dt.timedelta(days=day))
    parts = [[at(1, 1, 0), at(2, 1, 0.1), at(3, 2, 0)], [at(4, 2, 0.5), at(5, 2, 3)], [at(6, 2, 3.1)], [at(7, 1, 4), at(8, 2, 3.2)]]
    said = run(spark, tmp_path, lambda s: stateful.stream_thread_events(s, ["user_id", "topic"], STAGES, "1 hour", expire_ms=86_400_000), parts, schema)
    assert {x.event_id: (x.novelty, x.prior_count) for x in said.collect()} == {1: ("FIRST", 0), 2: ("DUPLICATE_REBROADCAST", 1), 3: ("FIRST", 0), 4: ("DUPLICATE_REBROADCAST", 1), 5: ("DUPLICATE_REBROADCAST", 2), 6: ("DUPLICATE_REBROADCAST", 3), 7: ("FIRST", 0), 8: ("DUPLICATE_REBROADCAST", 4)}


def test_sessions_close_once(spark, tmp_path):
    schema = "session_id long, window_start timestamp, status string, scheduled_at timestamp, session_end timestamp, version long, ts timestamp"
    end = START + dt.timedelta(hours=4)
    row = lambda s, hour, status, version, at: (s, START + dt.timedelta(hours=hour), status, START + dt.timedelta(hours=hour + 1), end, version, START + dt.timedelta(hours=at))
    parts = [
        [row(1, 0, "DUE", 1, 0), row(1, 1, "DUE", 1, 1), row(1, 3, "CLAIMED", 1, 1), row(1, 4, "DUE", 1, 1), row(2, 0, "DUE", 1, 1)],
        [row(1, 1, "VALID", 2, 2), row(1, 1, "DUE", 1, 2)],  # a later version, and an older one again
        [row(9, 0, "VALID", 1, 7)],  # the watermark passes the end
        [row(1, 0, "VALID", 3, 9), row(2, 0, "DUE", 4, 9), row(9, 1, "VALID", 1, 20)],
        [row(9, 2, "VALID", 1, 30)],
    ]
    said = run(spark, tmp_path, lambda s: stateful.stream_confirm_missing(s, "1 hour"), parts, schema)
    hours = lambda us: (us - int((START - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6) // 3_600_000_000
    assert sorted((x.session_id, hours(x.window_start), x.status) for x in said.collect() if x.session_id != 9) == [(1, 0, "MISSING"), (1, 1, "VALID"), (1, 3, "MISSING"), (2, 0, "MISSING")]


@pytest.mark.parametrize("most", [1000, 0])
def test_mentions(spark, most):
    """The automaton, and the joins beyond its bound, against a search for each name in each text."""
    r = random.Random(7)
    bit = lambda n: "".join(r.choice("abé가나 ") for _ in range(n))
    names = [(k, bit(r.randint(1, 5))) for k in range(120)] + [(500, "ab　 a"), (501, "dup"), (502, "dup"), (503, None), (None, "abab"), (504, "ａｂｂｂ")]
    texts = [(k, bit(r.randint(0, 60))) for k in range(150)] + [(900, None), (901, ""), (902, "x dup abab ééa ａbbb"), (903, "가나" * 20_000), (3, "가나다 ab  a")]
    import unicodedata

    norm = lambda x: " ".join(unicodedata.normalize("NFKC", x).split())
    by = {}
    for e, n in names:
        if n is not None and e is not None and len(norm(n)) >= 3:
            by.setdefault(norm(n), set()).add(e)
    want = sorted({(d, next(iter(e))) for d, x in texts if x is not None for n, e in by.items() if len(e) == 1 and n in norm(x)})
    got = mentions.dictionary_mentions(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(names, "entity_id long, name string"), max_names=most)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 50
    assert mentions.dictionary_mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "entity_id long, name string"), max_names=most).collect() == []


def test_a_key_costs_few_calls():
    """A fold asks for a key's state once and puts it back once; a timer is set only where none is, as each is a call to the JVM."""
    from pyspark.sql import Row

    class State:
        def __init__(self, calls):
            self.calls, self.value = calls, None

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                if name in ("update", "put"):
                    (self.value,) = args
                return self.value is not None if name == "exists" else self.value

            return call

    class Handle:
        def __init__(self):
            self.calls, self.timers = [], []

        def getValueState(self, *_):
            return State(self.calls)

        getListState = getValueState

        def listTimers(self):
            self.calls.append("listTimers")
            return list(self.timers)

        def deleteTimer(self, t):
            self.calls.append("deleteTimer")
            self.timers.remove(t)

        def registerTimer(self, t):
            self.calls.append("registerTimer")
            self.timers.append(t)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    row = Row("k", "ts", "_at", "_id", "x")
    fold = stateful.OrderedFold(lambda s, r: ({"n": (s or {"n": 0})["n"] + r["x"]}, {"n": (s or {"n": 0})["n"] + r["x"]}), ["k"], "id", ["x"], ["n"])
    handle = Handle()
    fold.init(handle)
    said = [tuple(x) for x in fold.handleInputRows((1,), iter([row(1, None, 5000, 1, 3), row(1, None, 2000, 2, 4)]), Now())]
    assert said == [(1, 2, 4, 1), (1, 1, 7, 1)] and len(handle.calls) <= 3
    handle.calls.clear()
    said = [tuple(x) for x in fold.handleInputRows((1,), iter([row(1, None, 3000, 3, 1), row(1, None, 9000, 4, 1)]), Now())]
    assert said == [(1, 3, 5, 1), (1, 1, 8, 2), (1, 4, 9, 1)] and len(handle.calls) <= 2 and handle.timers == [6]
