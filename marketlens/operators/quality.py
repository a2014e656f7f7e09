"""Data-quality gates and merges. Gates collect all reasons, tell blocking ones from warnings, and keep failures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule is broken where `fails` is true; null counts as not broken."""

    name: str
    fails: Column
    blocking: bool = True


def judged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df with reasons (broken blocking rules), warnings and passed."""
    pick = lambda blocking: F.array_compact(F.array(*[F.when(r.fails, F.lit(r.name)) for r in rules if r.blocking == blocking], F.lit(None).cast("string")))
    return df.withColumn("reasons", pick(True)).withColumn("warnings", pick(False)).withColumn("passed", F.size("reasons") == 0)


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined), both with reasons and warnings."""
    out = judged(df, rules)
    return out.where("passed").drop("passed"), out.where("NOT passed").drop("passed")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def _late(c: str, max_date: date, min_date: date = date(1990, 1, 1)) -> Column:
    return (F.col(c) > F.lit(max_date)) | (F.col(c) < F.lit(min_date))


def _wild(c: str) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def ohlcv_rules() -> list[Rule]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return [
        Rule("non_positive_price", F.least(o, h, lo, c) <= 0),
        Rule("negative_volume", F.col("volume") < 0),
        Rule("high_below_low", h < lo),
        Rule("high_below_body", h < F.greatest(o, c)),
        Rule("low_above_body", lo > F.least(o, c)),
    ]


def holdings_rules(max_date: date, markets: Sequence[str] = ("KR", "US")) -> list[Rule]:
    return [
        Rule("missing_market", _blank("market")),
        Rule("unsupported_market", ~_blank("market") & ~F.col("market").isin(list(markets))),
        Rule("missing_fund", _blank("etf_id")),
        Rule("missing_constituent", _blank("constituent_ticker")),
        Rule("date_out_of_range", F.col("as_of_date").isNull() | _late("as_of_date", max_date)),
        Rule("weight_out_of_range", ~((F.col("weight_pct") > 0) & (F.col("weight_pct") <= 100)), blocking=False),
        Rule("negative_shares", F.col("shares") < 0, blocking=False),
        Rule("negative_value", F.col("market_value") < 0, blocking=False),
    ]


def nav_rules(max_date: date) -> list[Rule]:
    return [Rule("missing_fund", _blank("etf_id")), Rule("missing_nav", F.col("nav").isNull()), Rule("non_positive_nav", F.col("nav") <= 0), Rule("nav_too_large", F.col("nav") >= 1e16), Rule("date_out_of_range", F.col("trade_date").isNull() | _late("trade_date", max_date))]


def profile_rules() -> list[Rule]:
    return [Rule("missing_fund", _blank("etf_id")), Rule("missing_market", _blank("market")), Rule("missing_name", _blank("display_name"))]


def news_rules(max_date: date) -> list[Rule]:
    published = F.col("published_at").try_cast("timestamp")
    return [
        Rule("missing_title", _blank("title")),
        Rule("unparsed_date", published.isNull()),
        Rule("implausible_date", (F.to_date(published) > F.lit(max_date)) | (F.to_date(published) < F.lit(date(1990, 1, 1)))),
        Rule("missing_url", _blank("url"), blocking=False),
        Rule("missing_publisher", _blank("publisher"), blocking=False),
    ]


def supply_rules(max_date: date) -> list[Rule]:
    return [
        Rule("missing_id", _blank("rcept_no")),
        Rule("date_out_of_range", F.col("report_date").isNull() | _late("report_date", max_date)),
        Rule("empty_parse", _blank("counterparty") & F.col("amount").isNull() & F.col("ratio_pct").isNull()),
        Rule("ratio_not_finite", _wild("ratio_pct")),
        Rule("amount_out_of_range", F.abs("amount") >= float(2**63)),
        Rule("counterparty_withheld", F.col("counterparty_withheld"), blocking=False),
        Rule("missing_amount", F.col("amount").isNull(), blocking=False),
        Rule("ratio_out_of_range", (F.col("ratio_pct") < 0) | (F.col("ratio_pct") > 1000), blocking=False),
    ]


def segment_rules(max_date: date) -> list[Rule]:
    return [
        Rule("missing_id", _blank("rcept_no")),
        Rule("missing_segment", _blank("segment_name")),
        Rule("date_out_of_range", F.col("report_date").isNull() | _late("report_date", max_date)),
        Rule("no_amounts", F.col("revenue").isNull() & F.col("revenue_share_pct").isNull()),
        Rule("share_out_of_range", (F.col("revenue_share_pct") < -100) | (F.col("revenue_share_pct") > 100), blocking=False),
    ]


def flow_rules(required: Sequence[str], optional: Sequence[str]) -> list[Rule]:
    return [Rule("missing_ticker", _blank("ticker")), *[Rule(f"missing_{c}", F.col(c).isNull()) for c in required], *[Rule(f"missing_{c}", F.col(c).isNull(), blocking=False) for c in optional]]


def load_price_rules() -> list[Rule]:
    bad = lambda c: F.col(c).isNull() | _wild(c) | (F.col(c) <= 0)
    return [Rule("bad_close", bad("close")), Rule("bad_adjusted", F.col("adj_close").isNotNull() & bad("adj_close")), Rule("negative_volume", F.col("volume") < 0)]


def flow_load_rules(columns: Sequence[str]) -> list[Rule]:
    return [Rule("missing_ticker", _blank("ticker")), *[Rule(f"fraction_{c}", F.col(c) != F.floor(c)) for c in columns]]


def merge_latest(existing: DataFrame, new: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """Per key the row fetched last, as an instant; of equal ones the incoming."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy(F.col(ts).cast("timestamp").desc(), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def merge_exclusive_vendor(existing: DataFrame, new: DataFrame, key: Sequence[str], vendor: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """merge_latest(), and the keys that two vendors supply, which are left out of it."""
    both = existing.unionByName(new, allowMissingColumns=True)
    clash = both.groupBy(*key).agg(F.array_sort(F.collect_set(vendor)).alias("vendors")).where(F.size("vendors") > 1)
    return merge_latest(existing, new, key, ts).join(clash, list(key), "left_anti"), clash


def merge_union_mentions(existing: DataFrame, new: DataFrame, key: Sequence[str], ts: str, mentions: str = "mentions") -> DataFrame:
    """The newest row's values, with the mentions (arrays) of all."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in (*key, mentions)]
    out = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts).cast("timestamp"), "_new")).alias("_x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(mentions)))).alias(mentions))
    return out.select(*key, "_x.*", mentions)


def board_collisions(df: DataFrame, key: str, board: str) -> DataFrame:
    """Keys with several boards."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(board)).alias("boards")).where(F.size("boards") > 1)


def verify_intraday(bars: DataFrame, daily: DataFrame, min_bar_ratio: float, max_partial: float, key: str = "symbol", day: str = "trade_date", ts: str = "ts") -> DataFrame:
    """Per day: duplicate bars, modal bars per symbol, share of symbols far below it, mismatched closes, and the verdict."""
    from .bars import reconcile_sources

    n = bars.groupBy(key, day).agg(F.count("*").alias("_n"), F.countDistinct(ts).alias("_u"))
    mode = n.groupBy(day, "_n").agg(F.count("*").alias("_c")).groupBy(day).agg(F.max_by("_n", F.struct("_c", "_n")).alias("modal_bars"))
    out = n.join(mode, day).groupBy(day).agg(F.sum(F.col("_n") - F.col("_u")).alias("duplicates"), F.first("modal_bars").alias("modal_bars"), F.avg((F.col("_n") < min_bar_ratio * F.col("modal_bars")).cast("int")).alias("partial_share"))
    out = out.join(reconcile_sources(daily, bars, key=key, day_col=day, ts=ts), day)
    return out.withColumn("ok", (F.col("duplicates") == 0) & (F.col("partial_share") <= max_partial) & ~F.col("failed")).drop("failed")


def truncation_check(rows: DataFrame, requests: DataFrame, request: str, at: str, since: str) -> DataFrame:
    """Requests whose answer doesn't reach back to what was asked, or is empty."""
    got = rows.groupBy(request).agg(F.min(at).alias("reached"))
    return requests.join(got, request, "left").withColumn("truncated", F.col("reached").isNull() | (F.col("reached") > F.col(since)))


def unfilled_days(settled: DataFrame, partitions: DataFrame, owner: str, day: str = "trade_date", writer: str = "source_vendor") -> DataFrame:
    """Settled days without a derived partition (MISSING), or with one of another writer (CONTESTED)."""
    w = partitions.groupBy(day).agg(F.count_if(~F.col(writer).eqNullSafe(F.lit(owner))).alias("_foreign"))
    out = settled.select(day).distinct().join(w, day, "left")
    return out.withColumn("state", F.when(F.col("_foreign").isNull(), "MISSING").when(F.col("_foreign") > 0, "CONTESTED")).where("state IS NOT NULL").drop("_foreign")


def plan_contiguity(windows: DataFrame, seconds: int, session: str = "session_id", start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Per session: windows, wrong spans, gaps between windows, first and last bounds."""
    w = Window.partitionBy(session).orderBy(start)
    j = windows.withColumn("_prev", F.lag(end).over(w))
    span = F.unix_seconds(F.col(end).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))
    return j.groupBy(session).agg(F.count("*").alias("n"), F.count_if(span != seconds).alias("wrong_span"), F.count_if(F.col("_prev").isNotNull() & (F.col("_prev") != F.col(start))).alias("gaps"), F.min(start).alias("first"), F.max(end).alias("last"))


def session_checksum(windows: DataFrame, cols: Sequence[str], session: str = "session_id") -> DataFrame:
    """Per session a digest of its windows' results, whatever their order. A session has a bounded number of windows."""
    return windows.groupBy(session).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*cols)))), "\n"), 256).alias("checksum"))


def needs_retag(articles: DataFrame, features: DataFrame, keys: Sequence[str] = ("article_id", "input_fingerprint", "version")) -> DataFrame:
    """Articles without a feature row of the same input and version."""
    return articles.join(features.select(*keys).distinct(), list(keys), "left_anti")


def screen_items(items: DataFrame, phrases: Sequence[str], min_sources: int, min_confidence: float, uncertain: Sequence[str], item: str = "item_id", text: str = "text") -> DataFrame:
    """Items with decision and every matched rule: BLOCKED by a banned phrase, REVIEW_REQUIRED by few sources, low confidence or an uncertain type, else AUTO_PUBLISHED. The policy's rules are a short list."""
    banned = [F.when(F.contains(F.lower(text), F.lit(p.lower())), F.lit(f"banned:{p}")) for p in phrases]
    review = [F.when(F.col("n_sources") < min_sources, F.lit("few_sources")), F.when(F.col("confidence") < min_confidence, F.lit("low_confidence")), F.when(F.col("kind").isin(list(uncertain)), F.lit("uncertain_kind"))]
    out = items.withColumn("_b", F.array_compact(F.array(*banned))).withColumn("_r", F.array_compact(F.array(*review)))
    decision = F.when(F.size("_b") > 0, "BLOCKED").when(F.size("_r") > 0, "REVIEW_REQUIRED").otherwise("AUTO_PUBLISHED")
    return out.withColumn("decision", decision).withColumn("rules", F.concat("_b", "_r")).drop("_b", "_r")


def outlier_days(outputs: DataFrame, holidays: DataFrame, n: int, factor: float, group: str = "output", day: str = "day", value: str = "n") -> DataFrame:
    """Business days whose output is over factor times, or under 1 / factor of, the median of the n business days before."""
    own = outputs.join(holidays.select(day), day, "left_anti").where(~F.dayofweek(day).isin(1, 7))
    base = F.expr(f"array_sort(collect_list({value}) OVER (PARTITION BY {group} ORDER BY {day} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))")
    j = own.withColumn("_l", base).where(F.size("_l") == n)
    mid = (F.try_element_at("_l", F.lit((n + 1) // 2)) + F.try_element_at("_l", F.lit(n // 2 + 1))) / 2
    return j.withColumn("baseline", mid).drop("_l").where((F.col(value) > factor * F.col("baseline")) | (F.col(value) < F.col("baseline") / factor))


def fact_rules(facts: DataFrame, rules: Sequence[Rule], causes: Sequence[tuple[str, str]], run: str = "run_id", target: str = "target") -> DataFrame:
    """Violations of each rule, and by which violated cause of the same run and target each is explained, if any."""
    found = judged(facts, rules).select(run, target, F.explode(F.concat("reasons", "warnings")).alias("rule"))
    edges = facts.sparkSession.createDataFrame(list(causes), "rule string, cause string")  # a short list of rule pairs
    why = found.join(F.broadcast(edges), "rule").join(found.select(run, target, F.col("rule").alias("cause")), [run, target, "cause"], "left_semi")
    return found.join(why.groupBy(run, target, "rule").agg(F.min("cause").alias("explained_by")), [run, target, "rule"], "left")


def claim_direction_check(claims: DataFrame, supports: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Directional claims with a verdict: SUPPORTED needs a signed, measured support of its direction and none against."""
    s = supports.where("measured AND sign IS NOT NULL").join(claims.select(claim, "direction"), claim)
    g = s.groupBy(claim).agg(F.bool_or(F.col("sign") == F.col("direction")).alias("_for"), F.bool_or(F.col("sign") == -F.col("direction")).alias("_against"))
    out = claims.join(g, claim, "left")
    verdict = F.when(F.coalesce("_against", F.lit(False)), "CONTRADICTED").when(F.coalesce("_for", F.lit(False)), "SUPPORTED").otherwise("UNSUPPORTED")
    return out.withColumn("verdict", verdict).drop("_for", "_against")


def set_partition_check(classes: DataFrame, expected: DataFrame, unit: str = "unit", cls: str = "class") -> DataFrame:
    """One row: expected units in no class, units in a class that weren't expected, units in several classes."""
    got = classes.groupBy(unit).agg(F.countDistinct(cls).alias("_n"))
    j = expected.select(unit, F.lit(1).alias("_e")).distinct().join(got, unit, "full")
    return j.agg(F.count_if(F.col("_n").isNull()).alias("dropped"), F.count_if(F.col("_e").isNull()).alias("extra"), F.count_if(F.col("_n") > 1).alias("duplicated"))


def dual_watermark(windows: DataFrame, session: str = "session_id", start: str = "window_start", end: str = "window_end", status: str = "status") -> DataFrame:
    """Per session: processed_through, the last end of a finished window, and contiguous_through, the end of the unbroken run of VALID ones from the start."""
    valid = F.col(status).isin("VALID", "VALID_EMPTY")
    hole = windows.groupBy(session).agg(F.min(F.when(~valid, F.col(start))).alias("_hole"), F.max(F.when(~F.col(status).isin("DUE", "CLAIMED"), F.col(end))).alias("processed_through"))
    run = windows.join(hole, session).where(valid & (F.col("_hole").isNull() | (F.col(start) < F.col("_hole")))).groupBy(session).agg(F.max(end).alias("contiguous_through"))
    return hole.drop("_hole").join(run, session, "left")


def confirm_missing(windows: DataFrame, now: datetime, status: str = "status", scheduled: str = "scheduled_at") -> DataFrame:
    """Windows with status as of a session's end: those still due whose time had come are MISSING."""
    return windows.withColumn(status, F.when(F.col(status).isin("DUE", "CLAIMED") & (F.col(scheduled) <= F.lit(now)), "MISSING").otherwise(F.col(status)))


def late_correction(rows: DataFrame, key: Sequence[str], generation: str = "generation") -> DataFrame:
    """The row of the highest generation of each key; stale generations are dropped."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), generation).alias("_x")).select(*key, "_x.*")
