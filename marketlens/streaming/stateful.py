"""Streams with state of their own and event-time timers: folds in order whose rows may come late, and sessions that close.

Both keep their state in RocksDB, so a key's state is read and written apart from all others, and survives a lost executor
by the stream's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: (state, row's fields) -> (state, what is said of the row). States and fields are plain values.
Step = Callable[[dict | None, dict], tuple[dict | None, dict]]


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for streams started within; the session's own setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class OrderedFold(StatefulProcessor):
    """A fold over each key's rows by (time, id), whenever they come.

    State is what the rows behind the watermark add up to, and the rows since, each with what was last said of it. A row
    that comes late is put in its place, and all rows of which something else is to be said now are said again, with a
    higher revision. Rows that the watermark has passed can't change any more: they are folded away, by a timer where no
    row comes. A key without rows for `expire` milliseconds of event time loses its state.

    Each call to the state goes to the JVM and back, so a key's state is one value, read and written once, with the time of
    its only timer. A timer that comes before it is needed stays, and is set anew when it fires.
    """

    def __init__(self, step: Step, key: Sequence[str], id_: str, fields: Sequence[str], said: Sequence[str], expire: int | None = None):
        self.step, self.names, self.fields, self.said, self.expire = step, (*key, id_, *said, "revision"), tuple(fields), tuple(said), expire
        #: Where a row, as ordered_fold() makes it, has its time, its id and its fields.
        self.at = len(key) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, Row(*self.names)
        self.state = handle.getValueState("held", "timer long, text string")

    def _held(self) -> tuple[tuple | None, list, list[list]]:
        """The state as it is stored, what is folded away (time, id, state), and the rows since: time, id, fields, what was said, revision."""
        stored = self.state.get()
        if stored is None:
            return None, [-(2**63), 0, None], []
        stored = tuple(stored)
        *base, rows = json.loads(stored[1])
        return stored, base, rows

    def _settle(self, key: tuple, rows: list[list], base: list, stored: tuple | None, timer: int | None, watermark: int) -> Iterator[Row]:
        """Folds rows, which are in order, says what changed, and keeps what can still change. timer: the one that is set."""
        kept, now, left = base, base[2], []
        for row in rows:
            now, what = self.step(now, dict(zip(self.fields, row[2], strict=True)))
            said = [what[c] for c in self.said]
            if said != row[3]:
                row[3], row[4] = said, row[4] + 1
                yield self.out(*key, row[1], *said, row[4])
            if row[0] < watermark * 1000:
                kept = [row[0], row[1], now]
            else:
                left.append(row)
        due = left[-1][0] // 1000 + 1 if left else None if self.expire is None else kept[0] // 1000 + self.expire
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        state = (timer, json.dumps([*kept, left]))
        if state != stored:
            self.state.update(state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored, base, held = self._held()
        places, at, end = {(r[0], r[1]) for r in held}, self.at, self.at + 2
        for r in rows:
            place = (r[at], r[at + 1])
            # A row that came before, or that belongs before what is folded away, changes nothing.
            if place not in places and place > (base[0], base[1]):
                places.add(place)
                held.append([*place, list(r[end:]), None, 0])
        held.sort(key=lambda r: (r[0], r[1]))
        yield from self._settle(key, held, base, stored, stored and stored[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored, base, held = self._held()
        watermark = timerValues.getCurrentWatermarkInMs()
        if not held and self.expire is not None and base[0] // 1000 + self.expire <= watermark:
            self.state.clear()
            return
        yield from self._settle(key, held, base, stored, None, watermark)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, key: Sequence[str], ts: str, id_: str, fields: Sequence[str], step: Step, said: str, late: str, expire_ms: int | None = None) -> DataFrame:
    """key, id, what step says of each row (said: a schema), revision: of equal key and id the highest revision holds.

    late: how long rows may come after later ones. Each row has a time and an id, a long that tells rows of one time apart.
    """
    kinds = dict(stream.dtypes)
    names = [x.split()[0] for x in said.split(", ")]
    out = StructType.fromDDL(", ".join([*(f"{k} {kinds[k]}" for k in key), f"{id_} long", said, "revision int"]))
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(*key, ts, F.unix_micros(ts).alias("_at"), F.col(id_).cast("long").alias("_id"), *fields)
    return rows.groupBy(*key).transformWithState(OrderedFold(step, key, id_, fields, names, expire_ms), out, "Append", "EventTime")


def last_revisions(said: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of what a fold said, what holds in the end: the row of the highest revision of each key."""
    rest = [c for c in said.columns if c not in key]
    return said.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("_x")).select(*key, "_x.*")


def observe(state: dict | None, row: dict) -> tuple[dict, dict]:
    """One observation of a news item (item, hash, seen, url_id) after those before.

    NEW; UNCHANGED; CONTENT_CHANGED (generation + 1); ID_PROMOTED, where the article's id so far stood for an unknown
    address and this one has it; STALE, seen before the last one; IDENTITY_CONFLICT with an address known before;
    CHECKSUM_CONFLICT, another content at the same moment. An address counts however late it comes, and is never taken back;
    a conflict changes nothing else.
    """
    url, fallback = row["url_id"], f"item:{row['item_id']}"
    if state is None:
        state = {"hash": row["hash"], "generation": 1, "article_id": url or fallback, "seen": row["seen"]}
        return state, {"observation": "NEW", "promoted": False, "generation": 1, "article_id": state["article_id"]}
    state = dict(state)
    conflict = url is not None and state["article_id"] not in (fallback, url)
    promoted = url is not None and not conflict and state["article_id"] != url
    if promoted:
        state["article_id"] = url
    changed = row["hash"] != state["hash"]
    if conflict:
        what = "IDENTITY_CONFLICT"
    elif row["seen"] < state["seen"]:
        what = "STALE"
    elif changed and row["seen"] == state["seen"]:
        what = "CHECKSUM_CONFLICT"
    else:
        what = "CONTENT_CHANGED" if changed else "ID_PROMOTED" if promoted else "UNCHANGED"
        state |= {"hash": row["hash"], "seen": row["seen"], "generation": state["generation"] + int(changed)}
    return state, {"observation": what, "promoted": promoted, "generation": state["generation"], "article_id": state["article_id"]}


def stream_news_observe(stream: DataFrame, late: str, ts: str = "ts", seq: str = "seq", expire_ms: int | None = None) -> DataFrame:
    """item_id, seq, observation, promoted, generation, article_id, revision: observe() over each item's observations by (ts, seq), in whatever order they come. Columns: item_id, hash, seen, url_id."""
    return ordered_fold(stream, ["item_id"], ts, seq, ["item_id", "hash", "seen", "url_id"], observe, "observation string, promoted boolean, generation int, article_id string", late, expire_ms)


def threading(stages: dict[str, int]) -> Step:
    """A step that threads events (stage, is_correction): novelty, how many came before, the stage the thread has reached, and when it opened."""

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        state = dict(state) if state else {"n": 0, "best": 0, "stage": None, "opened": row["at"]}
        rank = stages.get(row["stage"], 0)
        further = rank > state["best"]
        what = "FIRST" if not state["n"] else "CORRECTION" if row["is_correction"] else "FOLLOW_UP_STAGE" if further else "DUPLICATE_REBROADCAST"
        said = {"novelty": what, "prior_count": state["n"], "current_stage": row["stage"] if further else state["stage"], "opened_at": state["opened"]}
        return {"n": state["n"] + 1, "best": max(rank, state["best"]), "stage": said["current_stage"], "opened": state["opened"]}, said

    return step


def stream_thread_events(stream: DataFrame, identity: Sequence[str], stages: dict[str, int], late: str, ts: str = "ts", event: str = "event_id", expire_ms: int | None = None) -> DataFrame:
    """identity, event_id, novelty, prior_count, current_stage, opened_at (microseconds), revision. Events without a full identity have no thread. With expire_ms a thread that nothing is added to for so long ends, and its next event is the first of another."""
    known = stream.dropna(subset=list(identity)).withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")))
    return ordered_fold(known, identity, ts, event, ["stage", "is_correction", "at"], threading(stages), "novelty string, prior_count long, current_stage string, opened_at long", late, expire_ms)


class SessionClose(StatefulProcessor):
    """A session's windows with their status, until the watermark passes its end. A timer then says the status of each
    window that had been scheduled by the end: MISSING if it was still due. It fires once; what comes later changes nothing."""

    def __init__(self, names: Sequence[str]):
        self.names = tuple(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, Row(*self.names)
        self.windows = handle.getMapState("windows", "start long", "status string, scheduled long, version long")
        self.closed = handle.getValueState("closed", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.closed.exists():
            end = None
            for r in rows:
                end, place = r["_end"], (r["_start"],)
                before = self.windows.getValue(place) if self.windows.containsKey(place) else None
                if before is None or r["_version"] > before[2]:
                    self.windows.updateValue(place, (r["_status"], r["_scheduled"], r["_version"]))
            if end is not None and not list(self.handle.listTimers()):
                self.handle.registerTimer(end // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        for start, (status, scheduled, _) in list(self.windows.iterator()):
            if scheduled <= end * 1000:
                yield self.out(*key, start[0], "MISSING" if status in ("DUE", "CLAIMED") else status)
        self.windows.clear()
        self.closed.update((end,))

    def close(self) -> None:
        pass


def stream_confirm_missing(stream: DataFrame, late: str, session: str = "session_id", start: str = "window_start", status: str = "status", scheduled: str = "scheduled_at", end: str = "session_end", version: str = "version", ts: str = "ts") -> DataFrame:
    """session, window_start (microseconds), status of the windows of each session that the watermark has passed, once. Of several rows of a window the highest version counts."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(session, ts, *(F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in ((start, "_start"), (scheduled, "_scheduled"), (end, "_end"))), F.col(status).alias("_status"), F.col(version).cast("long").alias("_version"))
    kind = dict(stream.dtypes)[session]
    return rows.groupBy(session).transformWithState(SessionClose((session, start, status)), StructType.fromDDL(f"{session} {kind}, {start} long, {status} string"), "Append", "EventTime")
