"""URL filter: stated rules, and a tree of path templates per host; DataFrame and SQL functions only.

The tree grows depth by depth, over distinct paths and their counts. At each node (a host and a template so far) the next
segments are counted: where they are many and mostly different they become a wildcard, else they stay. Then, depth by
depth, branches that differ in one segment only and whose labelled purity is statistically like that of all of them
together are merged into a wildcard; how a branch is labelled on all hosts counts there, so hosts without labels keep
branches apart that differ elsewhere. What is left are templates; one is rejected if its smoothed share of bad labels
exceeds a bound. A template's share over all hosts is the prior of its share on each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: (action, host, path): a rule fits its host and all subdomains of it, where the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: A template has so many segments at most: the last one stands for all that follow.
DEPTH = 6
#: Paths or templates that are broadcast, and their bytes as text, at most; beyond that a join shuffles.
BROADCAST, BROADCAST_BYTES = 100_000, 16 << 20
#: Tasks among which a hot host's rows are dealt.
SALTS = 16
#: A node's segments become a wildcard if more than CHILDREN differ, and they are more than DIFFERENT of its rows.
CHILDREN, DIFFERENT = 20, 0.1
#: Branches within so many standard errors of their pool are merged.
Z = 2.0
#: Labels that the prior counts for, and the share of bad ones from which a template is rejected.
SMOOTH, REJECT = 10.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, and its action; null where none fits. Of equally long ones, the first listed."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def _segments(path: Column, depth: int) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    rest = F.array_join(F.slice(parts, depth, F.greatest(F.size(parts) - (depth - 1), F.lit(1))), "/")
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(rest))).otherwise(parts)


def _met(rows: DataFrame, others: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle, whatever others' files take: templates are a fraction there of what they are in memory, so by the size of files alone they would be broadcast too late to fit the driver."""
    return rows.join(others.hint("merge"), on, how)


def _told(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """rows with few's columns (left join). few is broadcast up to a checked size; beyond it a hot key of rows is dealt to SALTS tasks."""
    few = written(few)
    n, size = few.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*few.columns)))), F.lit(0))).first()
    if n <= BROADCAST and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), on, "left")
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return _met(rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))), spread, [*on, "_salt"], "left").drop("_salt")


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, segs: an array; n: how many pages have them) with parts, the template's segments ("*" where they vary)."""
    now = written(paths.withColumn("parts", F.expr("cast(array() AS array<string>)")))
    deepest = now.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(deepest):
        seg = F.col("segs")[d]
        counted = now.where(F.size("segs") > d).groupBy("host", "parts", seg.alias("seg")).agg(F.sum("n").alias("n"))
        varying = (
            counted.groupBy("host", "parts")
            .agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
            .where((F.col("kinds") > CHILDREN) & (F.col("kinds") > DIFFERENT * F.col("n")))
            .select("host", "parts", F.lit(True).alias("varies"))
        )
        deeper = F.when(F.size("segs") > d, F.array_append("parts", F.when(F.col("varies"), F.lit("*")).otherwise(seg))).otherwise(F.col("parts"))
        now = _told(now, varying, ["host", "parts"]).withColumn("parts", deeper).drop("varies")
        if d % 2:
            now = written(now)
    return now


def merged(counted: DataFrame, deepest: int) -> DataFrame:
    """host, parts, final: counted (host, parts, n, labelled, bad, and all_labelled and all_bad of the parts on any host) with each template's segments after merging."""
    now = counted.withColumn("final", F.col("parts"))
    for d in range(deepest):
        pool = F.expr(f"transform(final, (x, i) -> IF(i = {d}, '*', x))")
        own = now.groupBy("host", "final").agg(F.sum("all_labelled").alias("own_n"), F.sum("all_bad").alias("own_bad")).where(F.size("final") > d).withColumn("pool", pool)
        # Only templates that carry labels say what the pool is like.
        pools = own.groupBy("host", "pool").agg(F.sum("own_n").alias("pool_n"), F.sum("own_bad").alias("pool_bad"), F.count("*").alias("branches")).where("branches > 1")
        p = (F.col("pool_bad") + 1) / (F.col("pool_n") + 2)
        off = F.abs((F.col("own_bad") + p) / (F.col("own_n") + 1) - p) / F.sqrt(p * (1 - p) / (F.col("own_n") + 1))
        like = _met(own, pools, ["host", "pool"]).where(off <= Z).select("host", "final", "pool")
        # Written, as each depth refers to the one before three times.
        now = written(_met(now, like, ["host", "final"], "left").withColumn("final", F.coalesce("pool", "final")).drop("pool"))
    return now


def judged(pages: DataFrame, labels: DataFrame | None = None, rules: tuple = RULES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, template, purity, verdict of each row of pages (page_id, url).

    labels: page_id and bad (1 or 0); a page labelled twice counts as bad if any label is. Without labels, pages that a
    rule decides are labelled by it. A null url, or one without ://, has an empty host and path, and so the empty template.
    Null page_ids have no label of their own; rows that repeat are judged alike. Paths of any length are judged; from the
    depth-th segment on they are one. An empty table gives none. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", name).withColumn("action", action).withColumn("segs", _segments(F.col("path"), depth))
    if labels is None:
        own = own.withColumn("bad", (F.col("action") == "block").cast("int"))
    else:
        own = _met(own, labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")), ["page_id"], "left")
    own = written(own)
    # From here on a row stands for all pages of a host that share their segments.
    paths = own.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    grown = written(templates(paths))
    counted = grown.groupBy("host", "parts").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    shared = counted.groupBy("parts").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    counted = written(_told(counted, shared, ["parts"]))
    totals = counted.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad"), F.max(F.size("parts")).alias("deepest")).first()
    prior = min(((totals.bad or 0) + 1) / ((totals.n or 0) + 2), REJECT)  # without labels on any host no template is rejected
    final = merged(counted, totals.deepest or 0)
    pure = final.groupBy("host", "final").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad"))
    like = pure.groupBy("final").agg(((F.sum("bad") + SMOOTH * prior) / (F.sum("n") + SMOOTH)).alias("prior"))
    purity = (F.col("bad") + SMOOTH * F.col("prior")) / (F.col("n") + SMOOTH)
    told = _met(final.select("host", "parts", "final"), _told(pure, like, ["final"]), ["host", "final"]).select("host", "parts", F.concat(F.lit("/"), F.array_join("final", "/")).alias("template"), purity.alias("purity"))
    out = _told(own, _told(grown.select("host", "segs", "parts"), told, ["host", "parts"]).drop("parts"), ["host", "segs"])
    return out.select("page_id", "host", "path", "rule", "template", "purity", F.coalesce("action", F.when(F.col("purity") > REJECT, "block").otherwise("allow")).alias("verdict"))
