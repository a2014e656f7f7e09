"""Operational reporting: latest states, counts by status, gaps, ledgers and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.sink import written

from .stats import running


def latest_per_day_trend(attempts: DataFrame, n: int, day: str = "d", ok: str = "ok", ts: str = "ts") -> DataFrame:
    """The last successful attempt of each of the newest n days that have one, in ascending order."""
    last = attempts.where(F.col(ok)).withColumn("_n", F.row_number().over(Window.partitionBy(day).orderBy(F.desc(ts)))).where("_n = 1").drop("_n")
    return last.orderBy(F.desc(day)).limit(n).orderBy(day)


def ledger_latest(lanes: Mapping[str, DataFrame], outcomes: DataFrame, key: str, ts: str = "ts", ident: str = "trigger_id") -> DataFrame:
    """The latest trigger of each key over all lanes, with its outcome."""
    rows = None
    for lane, df in lanes.items():
        one = df.select(key, ts, ident, F.lit(lane).alias("lane"))
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy(key).agg(F.max_by(F.struct(ident, "lane", ts), F.struct(ts, ident)).alias("x")).select(key, "x.*")
    return last.join(outcomes, ident, "left")


def daily_outputs(tables: Mapping[str, tuple[DataFrame, str]], tz: str) -> DataFrame:
    """Rows per table and local day."""
    out = None
    for name, (df, ts) in tables.items():
        one = df.groupBy(F.lit(name).alias("output"), F.to_date(F.from_utc_timestamp(F.col(ts), tz)).alias("day")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def window_status_counts(windows: DataFrame, now: datetime, session: str = "session_id", status: str = "status", end: str = "window_end") -> DataFrame:
    """Per session and status: windows, and those due by now without evidence."""
    overdue = F.col(status).isin("DUE", "CLAIMED") & (F.col(end) < F.lit(now))
    return windows.groupBy(session, status).agg(F.count("*").alias("n"), F.count_if(overdue).alias("overdue"))


def gap_list(windows: DataFrame, now: datetime, session: str = "session_id", start: str = "window_start", status: str = "status", end: str = "window_end") -> DataFrame:
    """Windows that are missing, incomplete, invalid or overdue, with the reason."""
    reason = F.when(F.col(status).isin("MISSING", "INCOMPLETE", "INVALID"), F.col(status)).when(F.col(status).isin("DUE", "CLAIMED") & (F.col(end) < F.lit(now)), "OVERDUE")
    return windows.withColumn("reason", reason).where("reason IS NOT NULL").select(session, start, "reason")


def overview_latest(runs: DataFrame, tasks: DataFrame, stages: Sequence[str], pipeline: str = "pipeline", run: str = "run_id", started: str = "started_at", stage: str = "stage") -> DataFrame:
    """The latest run of each pipeline with its tasks, in the stages' order."""
    last = runs.groupBy(pipeline).agg(F.max_by(run, F.struct(started, run)).alias(run))
    order = F.coalesce(*[F.when(F.col(stage) == s, i) for i, s in enumerate(stages)], F.lit(len(stages)))
    return last.join(tasks, run, "left").withColumn("stage_order", order)


def missing_slots(issues: DataFrame, runs: DataFrame, slot: str) -> DataFrame:
    """Planned slots with an open issue and no run."""
    return issues.where("is_open").join(runs.select(slot), slot, "left_anti")


def job_counts(jobs: DataFrame, now: datetime, session: str = "session_id") -> DataFrame:
    """Per session: jobs waiting, claimed, expired (claimed too long), succeeded, dead."""
    s = F.col("status")
    late = F.col("lease_until") < F.lit(now)
    return jobs.groupBy(session).agg(
        F.count_if(s == "WAITING").alias("waiting"), F.count_if((s == "CLAIMED") & ~late).alias("claimed"), F.count_if((s == "CLAIMED") & late).alias("expired"), F.count_if(s == "SUCCEEDED").alias("succeeded"), F.count_if(s == "DEAD").alias("dead")
    )


def coverage_counts(docs: DataFrame, assertions: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """One row: documents, with an assertion, used."""
    a = assertions.select(key, F.lit(1).alias("_a")).distinct()
    u = usage.select(key, F.lit(1).alias("_u")).distinct()
    return docs.join(a, key, "left").join(u, key, "left").agg(F.count("*").alias("documents"), F.count("_a").alias("with_assertion"), F.count("_u").alias("used"))


def traffic_summary(requests: DataFrame, since: datetime, ts: str = "ts", error: Column | None = None) -> DataFrame:
    """One row: requests and errors since a time; zeros without any."""
    bad = error if error is not None else F.col("status") >= 500
    return requests.where(F.col(ts) >= F.lit(since)).agg(F.count("*").alias("requests"), F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).alias("errors"))


def status_count(items: DataFrame, statuses: Sequence[str], status: str = "status") -> DataFrame:
    return items.where(F.col(status).isin(list(statuses))).groupBy(status).agg(F.count("*").alias("n"))


def feed_summary(items: DataFrame, since: datetime, ts: str = "ts") -> DataFrame:
    """One row: received since a time, and the last one's time."""
    return items.agg(F.count_if(F.col(ts) >= F.lit(since)).alias("received"), F.max(ts).alias("last_received"))


def result_latest(results: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest result of each key, with a full tie-break."""
    return results.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")


def serving_head(publications: DataFrame, scopes: DataFrame, fund: str, market: str, order: Sequence[str]) -> DataFrame:
    """The latest published item of each fund that no scope blocks, by market or by fund. Two anti joins in place of an OR."""
    open_ = publications.where("published").join(scopes.where("kind = 'MARKET'").select(F.col("value").alias(market)), market, "left_anti")
    open_ = open_.join(scopes.where("kind = 'FUND'").select(F.col("value").cast(dict(publications.dtypes)[fund]).alias(fund)), fund, "left_anti")
    return result_latest(open_, [fund], order)


def evidence_top_per_type(evidence: DataFrame, n: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """At most n distinct rows of each key, with how many there were."""
    d = evidence.distinct()
    w = Window.partitionBy(*key)
    return d.withColumn("total", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(*order))).where(F.col("nth") <= n)


def top_contributors(df: DataFrame, col: str, n: int, key: str, group: Sequence[str] = ()) -> DataFrame:
    """The n rows with the largest |col|, of each group if there are groups; ties by key."""
    if not group:
        return df.orderBy(F.abs(col).desc(), key).limit(n)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.abs(col).desc(), key))).where(F.col("rank") <= n)


def capped_result(df: DataFrame, rows: int, size: int, order: Sequence[str]) -> DataFrame:
    """The first rows of a result, at most `rows` and at most `size` bytes as JSON, with whether it was cut."""
    head = df.orderBy(*order).limit(rows + 1)
    w = Window.orderBy(*order)  # over rows + 1 rows at most
    sized = head.withColumn("_nth", F.row_number().over(w)).withColumn("_bytes", F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = sized.agg(F.count("*").alias("_total"))
    kept = sized.where((F.col("_nth") <= rows) & (F.col("_bytes") <= size))
    n = kept.agg(F.count("*").alias("_kept"))
    return kept.join(F.broadcast(total)).join(F.broadcast(n)).withColumn("truncated", F.col("_kept") < F.col("_total")).drop("_nth", "_bytes", "_total", "_kept")


def page_by_time(df: DataFrame, ts: str, ident: str, limit: int, offset: int) -> DataFrame:
    """A page, newest first; ties by id."""
    return df.orderBy(F.desc(ts), F.desc(ident)).offset(offset).limit(limit)


def deterministic_order(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """df with a number by which it can be sampled or split, the same wherever rows are."""
    return df.withColumn("draw", F.xxhash64(F.lit(seed), *keys))


def contract_book(contracts: DataFrame, day: date, key: str, party: str, amount: str, start: str, end: str, reported: str) -> DataFrame:
    """Per owner: live and backlog amounts by date, concentration (HHI of parties over live ones), contracts that end within 90 days. Of restatements of a contract the latest counts."""
    last = result_latest(contracts.where(F.col(reported) <= F.lit(day)), ["owner", key], [reported])
    live = (F.col(start) <= F.lit(day)) & (F.col(end) > F.lit(day))
    last = last.withColumn("_live", F.when(live, F.col(amount))).withColumn("_back", F.when(F.col(start) > F.lit(day), F.col(amount)))
    by = last.groupBy("owner", party).agg(F.sum("_live").cast("double").alias("_p"))
    total = by.groupBy("owner").agg(F.sum("_p").alias("_t"))
    hhi = by.join(total, "owner").groupBy("owner").agg(F.sum(F.pow(F.col("_p") / F.nullif(F.col("_t"), F.lit(0.0)), 2)).alias("hhi"))
    out = last.groupBy("owner").agg(F.count_if(live).alias("n_live"), F.sum("_live").alias("live"), F.sum("_back").alias("backlog"), F.count_if(live & (F.col(end) <= F.date_add(F.lit(day), 90))).alias("expiring"))
    return out.join(hhi, "owner", "left")


def statement_pick(lines: DataFrame, accounts: Sequence[str], day: date, entity: str = "corp_code") -> DataFrame:
    """The annual amount of each entity: consolidated before separate, accounts in the order given, the latest one known."""
    rank = F.coalesce(*[F.when(F.col("account_id") == a, i) for i, a in enumerate(accounts)])
    ok = lines.where((F.col("available_at") <= F.lit(day)) & F.col("account_id").isin(list(accounts)))
    order = Window.partitionBy(entity).orderBy(F.desc("bsns_year"), F.when(F.col("fs_div") == "CFS", 0).otherwise(1), rank, F.desc("available_at"))
    return ok.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def consensus_revision(snapshots: DataFrame, day: date, horizon: int, key: str = "symbol", at: str = "as_of_date", value: str = "value") -> DataFrame:
    """Change between the latest snapshot up to day and the last one at least `horizon` days older, with its percent rank across keys: the share of the others below it, to 12 decimals. A key without a change has none and doesn't count."""
    from marketlens.functions.scalar import revision

    past = snapshots.where(F.col(at) <= F.lit(day))
    new = past.groupBy(key).agg(F.max(at).alias("latest_at"), F.max_by(value, at).alias("latest"))
    old = past.join(new, key).where(F.col(at) <= F.date_sub("latest_at", horizon)).groupBy(key).agg(F.max_by(value, at).alias("prior"))
    out = new.join(old, key).withColumn("revision", revision(F.col("latest"), F.col("prior")))
    out = written(out.withColumn("_v", F.round("revision", 12)))
    counts = running(out.where("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("_n")), "_v", "_n", "_upto")
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    below = counts.join(F.broadcast(total)).select("_v", F.coalesce(F.try_divide(F.col("_upto") - F.col("_n"), F.col("_all") - 1), F.lit(0.0)).alias("pct"))
    return out.join(below, "_v", "left").drop("_v")


def item_probe(items: DataFrame, code: str, day: date, window: int, key: str = "symbol", order: str = "trade_date", item: str = "item_code", value: str = "value") -> DataFrame:
    """One item on its keys' last day up to day: value, z over the `window` rows before, share of keys at or below it."""
    one = items.where((F.col(item) == code) & (F.col(order) <= F.lit(day)))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-window, -1)
    z = one.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))
    last = z.groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value), F.max_by("z", order).alias("z"))
    return last.withColumn("pct", F.cume_dist().over(Window.partitionBy(F.lit(1)).orderBy(value)))


def base_rate(panel: DataFrame, events: DataFrame, day: date, min_n: int, key: str = "symbol", order: str = "trade_date", value: str = "r") -> DataFrame:
    """Per key: day's value, the share of its past that is at least as large in size, and the same over past event days; null below min_n."""
    today = panel.where(F.col(order) == F.lit(day)).select(key, F.col(value).alias("today")).where("today IS NOT NULL")
    past = panel.where(F.col(order) < F.lit(day)).join(events.select(key, order, F.lit(True).alias("_e")).distinct(), [key, order], "left").join(today, key)
    hit = (F.abs(value) >= F.abs("today")).cast("int")
    ev = F.col("_e").isNotNull()
    out = past.where(F.col(value).isNotNull()).groupBy(key, "today").agg(F.count("*").alias("n"), F.avg(hit).alias("_p"), F.count_if(ev).alias("n_event"), F.avg(F.when(ev, hit)).alias("_pe"))
    return out.withColumn("exceed", F.when(F.col("n") >= min_n, F.col("_p"))).withColumn("exceed_event", F.when(F.col("n_event") >= min_n, F.col("_pe"))).drop("_p", "_pe")


def peer_rank(panel: DataFrame, day: date, min_peers: int, key: str = "symbol", order: str = "trade_date", sector: str = "sector", value: str = "r") -> DataFrame:
    """Rank of each key in its sector on a day, the sector's median, distance to it, share of peers of the same sign; sectors of fewer than min_peers get a verdict only."""
    own = panel.where((F.col(order) == F.lit(day)) & F.col(value).isNotNull())
    s = own.groupBy(sector).agg(F.median(value).alias("median"), F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("_up"), F.count_if(F.col(value) < 0).alias("_down"))
    j = own.join(s, sector).withColumn("rank", F.rank().over(Window.partitionBy(sector).orderBy(F.desc(value))))
    ok = F.col("n") >= min_peers
    same = F.when(F.col(value) > 0, F.col("_up") - 1).when(F.col(value) < 0, F.col("_down") - 1).otherwise(0) / F.nullif(F.col("n") - 1, F.lit(0))
    return j.select(key, sector, F.when(ok, F.col("rank")).alias("rank"), F.when(ok, F.col("median")).alias("median"), F.when(ok, F.col(value) - F.col("median")).alias("spread"), F.when(ok, same).alias("agreement"), F.when(ok, "MEASURED").otherwise("TOO_FEW_PEERS").alias("verdict"))


def event_distribution(events: DataFrame, panel: DataFrame, today: DataFrame, min_n: int, type_col: str = "event_type", key: str = "symbol", order: str = "trade_date", value: str = "r") -> DataFrame:
    """Per type: n, mean and the share of past values at or below today's (type, today); null below min_n."""
    past = events.join(panel, [key, order]).where(F.col(value).isNotNull()).join(today, type_col)
    out = past.groupBy(type_col).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) <= F.col("today")).cast("int")).alias("_e"))
    return out.withColumn("ecdf", F.when(F.col("n") >= min_n, F.col("_e"))).drop("_e")


def actor_flow(flows: DataFrame, turnover: DataFrame, actors: Sequence[str], day: date, window: int, z_window: int, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """Each key and actor on its last day up to day: flow over `window` rows over mean turnover, and its z; actors without flows stay, as nulls."""
    j = flows.where(F.col(order) <= F.lit(day)).join(turnover, [key, order])
    w = Window.partitionBy(key, "actor").orderBy(order)
    span, past = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-z_window, -1)
    j = j.withColumn("cum", F.sum("flow").over(span) / F.nullif(F.avg("turnover").over(span), F.lit(0.0)))
    j = j.withColumn("z", (F.col("cum") - F.avg("cum").over(past)) / F.nullif(F.stddev_samp("cum").over(past), F.lit(0.0)))
    last = j.groupBy(key, "actor").agg(F.max_by("cum", order).alias("cum"), F.max_by("z", order).alias("z"))
    grid = flows.select(key).distinct().withColumn("actor", F.explode(F.array(*map(F.lit, actors))))
    return grid.join(last, [key, "actor"], "left")
