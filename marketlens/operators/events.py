"""Events: links, treatments and controls, resolution, threads, funnels."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import date
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.sink import written


def join_date_broadcast(df: DataFrame, series: DataFrame, on: str = "trade_date", max_rows: int = 100_000) -> DataFrame:
    """df with a series of a row a date. It is broadcast if it has at most max_rows (centuries of days), else joined by shuffle."""
    small = series.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(series) if small else series, on, "left")


def control_pool(panel: DataFrame, treated: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of panel that are never treated."""
    return panel.join(treated.select(*key).distinct(), list(key), "left_anti")


def caliper_match(treated: DataFrame, pool: DataFrame, exact: Sequence[str], calipers: Mapping[str, float], k: int, unit: str = "symbol") -> DataFrame:
    """The k nearest controls of each treated row: equal in `exact`, within each caliper, by scaled distance, then unit.

    The first caliper's column is also cut into buckets of its width, and rows meet those of their own and the two
    neighbouring buckets. Where they meet a task looks outwards from each treated row along one of the calipers, only as far
    as something nearer may lie, so pairs are neither formed nor sorted: k rows leave each of the three buckets.
    """
    first, width = next(iter(calipers.items()))

    def side(df: DataFrame, p: str) -> DataFrame:
        known = F.col(unit).isNotNull()
        for c in exact:
            known = known & F.col(c).isNotNull()
        for c in calipers:
            known = known & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
        return df.where(known).select(*[F.col(c).alias(f"_{p}{n}") for n, c in enumerate(exact)], *[F.col(c).alias(f"{p}_{c}") for c in [unit, *calipers]])

    a = side(treated, "t").withColumn("_b", F.explode(F.array(*[F.floor(F.col(f"t_{first}") / width) + d for d in (-1, 0, 1)])))
    b = side(pool, "c").withColumn("_b", F.floor(F.col(f"c_{first}") / width))
    # Both sides may stem from one frame, so the keys that they meet by have names of their own.
    cells = [[*(f"_{p}{n}" for n in range(len(exact))), "_b"] for p in "tc"]
    kinds, theirs = dict(a.dtypes), [n for n in b.columns if n not in cells[1]]
    schema = ", ".join([*(f"`{c}` {kinds[n]}" for c, n in zip(exact, cells[0], strict=False)), *(f"`{n}` {kinds[n]}" for n in a.columns if n not in cells[0]), *(f"`{n}` {dict(b.dtypes)[n]}" for n in theirs), "distance double"])

    def near(one: pa.Table, two: pa.Table) -> pa.Table:
        at, to, gap = _nearest(one, two, unit, calipers, k)
        left = one.drop_columns(["_b"]).take(at)
        left = left.rename_columns([*exact, *left.column_names[len(exact) :]])
        for n in theirs:
            left = left.append_column(n, two.column(n).take(to))
        return left.append_column("distance", pa.array(gap, pa.float64()))

    order = Window.partitionBy(*exact, f"t_{unit}").orderBy("distance", f"c_{unit}")
    found = a.groupBy(*cells[0]).cogroup(b.groupBy(*cells[1])).applyInArrow(near, schema)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Candidates of one treated row looked at first, and distances worked out at a time.
LOOK, AT_ONCE = 32, 1 << 19


def _nearest(one: pa.Table, two: pa.Table, unit: str, calipers: Mapping[str, float], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of one (t_ columns) its k nearest rows of two (c_ columns) within the calipers, by distance, then unit, not itself: positions in both, distance."""
    none = np.empty(0, np.int64)
    if not len(one) or not len(two):
        return none, none, np.empty(0)
    names = pc.unique(two.column(f"c_{unit}"))
    names = names.take(pc.sort_indices(names))
    own, code = (pc.fill_null(pc.index_in(c, value_set=names), -1).to_numpy() for c in (one.column(f"t_{unit}"), two.column(f"c_{unit}")))
    xs, ys = (np.stack([np.asarray(df.column(f"{p}_{c}").to_numpy(), float) for c in calipers]) for df, p in ((one, "t"), (two, "c")))
    widths = np.array([float(w) for w in calipers.values()])
    # Along the caliper that spreads the pool most.
    axis = int(np.argmax(np.subtract(*np.percentile(ys, [75, 25], axis=1)) / widths))
    order = np.argsort(ys[axis], kind="stable")
    code, ys = code[order], ys[:, order]
    n, line = len(order), ys[axis]
    at, to, gap = [], [], []
    left, look = np.arange(len(one)), LOOK
    while len(left):
        again = []
        span = min(2 * look, n)
        for some in np.array_split(left, -(-len(left) * span // AT_ONCE)):
            x = xs[:, some]
            low = np.clip(np.searchsorted(line, x[axis]) - look, 0, n - span)
            near = low[:, None] + np.arange(span)
            apart = np.abs(x[:, :, None] - ys[:, near])
            d = np.zeros(near.shape)
            for gaps, w in zip(apart, widths, strict=True):
                d = d + gaps / w
            d[(apart > widths[:, None, None]).any(axis=0) | (code[near] == own[some][:, None])] = np.inf
            rows, last, best = np.arange(len(some)), None, []
            for _ in range(k):
                last = d.min(axis=1)
                pick = np.where(d == last[:, None], code[near], len(names)).argmin(axis=1)
                best.append((last, near[rows, pick]))
                d[rows, pick] = np.inf
            # What is outside the span is at least so far along the axis.
            before = np.where(low > 0, np.abs(x[axis] - line[np.maximum(low - 1, 0)]), np.inf)
            after = np.where(low + span < n, np.abs(x[axis] - line[np.minimum(low + span, n - 1)]), np.inf)
            edge = np.minimum(before, after)
            done = (last < edge / widths[axis]) | (edge > widths[axis])
            for dist, pos in best:
                ok = done & np.isfinite(dist)
                at.append(some[ok])
                to.append(order[pos[ok]])
                gap.append(dist[ok])
            again.append(some[~done])
        left, look = np.concatenate(again), look * 4
    return np.concatenate(at), np.concatenate(to), np.concatenate(gap)


def multi_treatment_flags(events: DataFrame, types: Sequence[str], key: Sequence[str], type_col: str = "event_type") -> DataFrame:
    """Keys treated by any of the types, with a 0/1 flag for each."""
    return events.where(F.col(type_col).isin(list(types))).groupBy(*key).agg(*[F.max(F.when(F.col(type_col) == x, 1).otherwise(0)).alias(f"is_{x}") for x in types])


def link_edges(arguments: DataFrame, rules: Sequence[tuple[str, str, str]], event: str = "event_id", role: str = "role", entity: str = "entity_id", at: str = "link_date", *, first: bool = False, distinct: bool = True, undirected: bool = False) -> DataFrame:
    """src, dst, link_type, link_date: entities with the two roles of a rule (role_a, role_b, type) in one event. With first, the first date of each link only. Without distinct, links of several events stand several times, for those who drop repeats themselves.

    undirected, for rules of a role with itself and those to whom links go both ways: two entities of an event stand once, at
    the earlier of their dates, not once each way; repeats of several events stay.

    Of rules for the same two roles the first counts. An argument meets those of its event by rule, so pairs without a rule
    are not formed.
    """
    pairs = list({(x, y): t for x, y, t in reversed(rules)}.items())
    types = sorted({t for _, t in pairs})
    if undirected and any(x != y for (x, y), _ in pairs):
        raise ValueError("undirected links are of a role with itself")

    def side(n: int, name: str) -> DataFrame:
        takes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(roles[n]).alias("role")) for k, (roles, _) in enumerate(pairs)])
        dated = [at] if n == 0 else [F.col(at).alias("_at")] if undirected else []
        rows = arguments.select(event, F.col(entity).alias(name), *dated, F.explode(F.filter(takes, lambda x: x["role"] == F.col(role))).alias("_x"))
        # By event and rule from the start: what is made distinct lies as the join needs it.
        return rows.withColumn("_rule", F.col("_x.k")).drop("_x").repartition(event, "_rule").distinct()

    # Types travel as numbers.
    kind = F.element_at(F.array(*[F.lit(types.index(t)) for _, t in pairs]), F.col("_rule") + 1)
    met = side(0, "src").join(side(1, "dst"), [event, "_rule"])
    if undirected:
        met = met.where(F.col("src") < F.col("dst")).select("src", "dst", kind.alias("_type"), F.least(at, "_at").alias(at))
    else:
        met = met.where(F.col("src") != F.col("dst")).select("src", "dst", kind.alias("_type"), at)
    met = met.groupBy("src", "dst", "_type").agg(F.min(at).alias(at)) if first else met.distinct() if distinct and not undirected else met
    return met.select("src", "dst", F.element_at(F.array(*[F.lit(t) for t in types]), F.col("_type") + 1).alias("link_type"), at)


def _ordered(x: str, y: str) -> list[Column]:
    """The lesser and the greater of two columns; null unless both are known."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    return [F.when(known, F.least(x, y)), F.when(known, F.greatest(x, y))]


def _first_links(edges: DataFrame, link_type: str, at: str) -> DataFrame:
    """a, b (a <= b), at: the first date of each pair of a type, whichever way it is linked. Edges without both ends are none."""
    own = edges.where(F.col("link_type") == link_type)
    return own.select(*[c.alias(n) for c, n in zip(_ordered("src", "dst"), "ab", strict=True)], at).where("a IS NOT NULL").groupBy("a", "b").agg(F.min(at).alias(at))


def first_links(edges: DataFrame, at: str = "link_date") -> DataFrame:
    """a, b (a <= b), at: the first date of each pair, whichever way and of whatever type it is linked."""
    return _first_links(edges.withColumn("link_type", F.lit("any")), "any", at)


def union_distinct_pairs(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Both directions of each edge, once. Edges are made distinct whichever way they go, and turned round after that."""
    rest = [c for c in edges.columns if c not in (a, b)]
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    once = edges.select(F.when(known, F.least(a, b)).alias("_lo"), F.greatest(a, b).alias("_hi"), *rest).distinct()
    there, back = F.struct(F.col("_lo").alias("a"), F.col("_hi").alias("b")), F.struct(F.col("_hi").alias("a"), F.col("_lo").alias("b"))
    ways = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.array(there)).otherwise(F.array(there, back))
    return once.select(F.explode(ways).alias("_e"), *rest).select(F.col("_e.a").alias(a), F.col("_e.b").alias(b), *rest)


def link_indicator(pairs: DataFrame, edges: DataFrame, link_type: str, x: str = "x", y: str = "y", day: str = "d", at: str = "link_date") -> DataFrame:
    """pairs with linked: whether an edge of the type joins x and y, in either direction, by the pair's date. The first such date of each pair decides, so one equi-join does."""
    low, high = _ordered(x, y)
    keyed = pairs.withColumn("_a", low).withColumn("_b", high)
    first = _first_links(edges, link_type, at).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col(at).alias("_first"))
    first = first.join(keyed.select("_a", "_b").distinct(), ["_a", "_b"], "left_semi")
    return keyed.join(first, ["_a", "_b"], "left").withColumn("linked", F.coalesce(F.col("_first") <= F.col(day), F.lit(False))).select(*pairs.columns, "linked")


#: Words of days that a block of entities has, about; links that a task passes days along at a time, and those in one step.
CELL, LINKS, STEP = 1_000_000, 1 << 19, 8_192
#: Blocks for the sake of tasks, where fewer would do, and the words from which a block is worth it.
BLOCKS, WORTH = 8, 16_384


class _Cell:
    """What entities of two blocks pass on to each other: their days as words of bits, and the days that their links have given so far."""

    def __init__(self, hit: pa.Table):
        self.names, self.words = pc.unique(hit.column("a")), np.unique(hit.column("n").to_numpy())
        self.bits = np.zeros((len(self.names), len(self.words)), np.uint64)
        self.bits[pc.index_in(hit.column("a"), value_set=self.names).to_numpy(), np.searchsorted(self.words, hit.column("n").to_numpy())] = hit.column("bits").to_numpy().view(np.uint64)
        self.ends, self.out = self.names.slice(0, 0), self.bits[:0]

    def pass_on(self, links: pa.Table) -> Iterator[pa.RecordBatch]:
        """Along links (a, b, n: the first day), both ways. What was given is told as soon as it holds more than CELL words."""
        for src, dst in (("a", "b"), ("b", "a")):
            at = pc.index_in(links.column(src), value_set=self.names)
            ok = pc.is_valid(at)
            to, at, t = links.column(dst).filter(ok), at.filter(ok).to_numpy(), links.column("n").filter(ok).to_numpy()
            if not len(at):
                continue
            more = pc.unique(to)
            more = more.filter(pc.invert(pc.is_in(more, value_set=self.ends)))
            self.ends = pa.concat_arrays([self.ends, more])
            self.out = np.concatenate([self.out, np.zeros((len(more), len(self.words)), np.uint64)])
            code = pc.index_in(to, value_set=self.ends).to_numpy()
            order = np.argsort(code, kind="stable")
            at, code, t = at[order], code[order], t[order]
            for k in range(0, len(at), STEP):
                own, late = code[k : k + STEP], t[k : k + STEP, None] - 64 * self.words
                from_date = np.where(late >= 64, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) << np.clip(late, 0, 63).astype(np.uint64))
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                self.out[own[starts]] |= np.bitwise_or.reduceat(self.bits[at[k : k + STEP]] & from_date, starts, axis=0)
            if self.out.size > CELL:
                yield from self.told()

    def told(self) -> Iterator[pa.RecordBatch]:
        row, col = np.nonzero(self.out)
        for k in range(0, len(row), LINKS):
            r, c = row[k : k + LINKS], col[k : k + LINKS]
            yield pa.RecordBatch.from_arrays([self.ends.take(pa.array(r)), pa.array(self.words[c], pa.int64()), pa.array(self.out[r, c].view(np.int64))], names=["dst", "word", "bits"])
        self.ends, self.out = self.ends.slice(0, 0), self.out[:0]


def _passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dst, word, bits: the days that entities get by links. Rows come by cell (i, j), days (without a b) before links."""
    at, cell, held, n, linked = None, None, [], 0, False

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal cell, held, n
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = pa.table({c: rows.column(c).combine_chunks() for c in rows.column_names})
            if not linked:
                cell = _Cell(rows)
            elif cell is not None:
                yield from cell.pass_on(rows)
        held, n = [], 0

    for batch in batches:
        i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
        link = pc.is_valid(batch.column("b")).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(link.astype(np.int8)) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
            if lo == hi:
                continue
            here = (i[lo], j[lo])
            if here != at or bool(link[lo]) != linked:
                yield from done()
                if here != at:
                    if cell is not None:
                        yield from cell.told()
                    at, cell = here, None
                linked = bool(link[lo])
            held.append(batch.slice(lo, hi - lo))
            n += hi - lo
            if linked and n >= LINKS:
                yield from done()
    yield from done()
    if cell is not None:
        yield from cell.told()


def spillover_treated(events: DataFrame, edges: DataFrame, event_type: str, link_type: str, entity: str = "entity_id", day: str = "d", at: str = "link_date") -> DataFrame:
    """(entity, day) of those linked, by that day, to one treated on it, and not treated themselves. day and at are dates.

    An entity's days are words of 64 bits, and a link passes on those from its date, both ways, so what a link gives is as
    many words as the days need, not a row for each event. A link that stands several times gives the same days again, so
    links aren't made distinct. Entities are dealt in blocks, and links in cells of two blocks; a task takes a cell's days
    first, and then its links as they come.
    """
    number = F.unix_date(day)
    own = events.where(F.col("event_type") == event_type).where(number.isNotNull() & F.col(entity).isNotNull()).select(F.col(entity).alias("src"), F.floor(number / 64).alias("word"), number.alias("n"))
    hit = written(own.groupBy("src", "word").agg(F.bit_or(F.expr("shiftleft(1L, cast(n - 64 * word AS int))")).alias("bits")))
    size = hit.agg(F.countDistinct("src").alias("names"), (F.max("word") - F.min("word") + 1).alias("words")).first()
    words = size["names"] * (size["words"] or 0)
    side = max(ceil(words / CELL), min(ceil(words / WORTH), BLOCKS), 1)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    cell = lambda df, x, y: df.withColumn("i", F.least(x, y)).withColumn("j", F.greatest(x, y))
    # Entities travel as one type: that of the edges.
    kind = dict(edges.dtypes)["dst"]
    known = edges.where((F.col("link_type") == link_type) & (F.col("src") != F.col("dst")) & F.col(at).isNotNull())
    links = cell(known.select(F.col("src").cast(kind).alias("a"), F.col("dst").alias("b"), F.unix_date(at).cast("long").alias("n"), F.lit(None).cast("long").alias("bits")), block("a"), block("b"))
    hits = hit.select(F.col("src").cast(kind).alias("a"), F.lit(None).cast(kind).alias("b"), F.col("word").alias("n"), "bits").withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    rows = cell(hits, block("a"), F.col("_x")).drop("_x").unionByName(links)
    # By number: what goes in is small beside the work, so partitions must not be put together by its size.
    many = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartition(many, "i", "j").sortWithinPartitions("i", "j", F.col("b").isNotNull()).mapInArrow(_passed_on, f"dst {kind}, word long, bits long").groupBy("dst", "word").agg(F.bit_or("bits").alias("bits"))
    left = near.join(hit.select(F.col("src").alias("dst"), "word", F.col("bits").alias("_own")), ["dst", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_own", F.lit(0).cast("long")))))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1))
    return left.where("bits <> 0").select(F.col("dst").alias(entity), "word", bit.alias("_k")).select(entity, F.date_from_unix_date((64 * F.col("word") + F.col("_k")).cast("int")).alias(day))


#: Parts of the instruments that events meet one by one.
PARTS = 16


def relation_panel(panel: DataFrame, events: DataFrame, edges: DataFrame, entity: str = "symbol", day: str = "trade_date", at: str = "link_date", take: Sequence[str] = ()) -> DataFrame:
    """The other instruments on each event's date, with whether they are related to the event's entity by then. take: more columns of events; each of their combinations counts as an event.

    Every event meets every instrument of its date. The pairs aren't shuffled: what an event's entity is linked to by then is
    looked up first, and goes with the event, in PARTS by instrument.
    """
    e = events.select(F.col(entity).alias("x"), F.col(day).alias("d"), *take).distinct()
    part = lambda y: F.pmod(F.xxhash64(y), F.lit(PARTS)).cast("int")
    first = first_links(edges, at)
    ends = first.select(F.col("a").alias("x"), F.col("b").alias("y"), at).unionByName(first.select(F.col("b").alias("x"), F.col("a").alias("y"), at))
    by = e.select("x", "d").distinct().join(ends, "x").where(F.col(at) <= F.col("d")).groupBy("x", "d", part("y").alias("_part")).agg(F.collect_set("y").alias("_linked"))
    dealt = written(e.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).join(by, ["x", "d", "_part"], "left"))
    # By number: what goes in is small beside the pairs, so partitions must not be put together by its size.
    many = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = panel.withColumnRenamed(entity, "y").withColumnRenamed(day, "d").withColumn("_part", part("y")).repartition(many, "d", "_part")
    pairs = own.join(dealt, ["d", "_part"]).where("x <> y")
    return pairs.withColumn("linked", F.coalesce(F.array_contains("_linked", F.col("y")), F.lit(False))).drop("_part", "_linked")


def same_attribute_flag(pairs: DataFrame, dim: DataFrame, attribute: str, x: str = "x", y: str = "y", key: str = "symbol") -> DataFrame:
    """pairs with whether both sides have the same known attribute."""
    a = dim.select(F.col(key).alias(x), F.col(attribute).alias("_a"))
    b = dim.select(F.col(key).alias(y), F.col(attribute).alias("_b"))
    return pairs.join(a, x, "left").join(b, y, "left").withColumn("same", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def typed_hop(nodes: DataFrame, edges: DataFrame, link_type: str, key: str = "entity_id") -> DataFrame:
    """The nodes one edge of a type away."""
    return edges.where(F.col("link_type") == link_type).join(nodes.select(F.col(key).alias("src")), "src", "left_semi").select(F.col("dst").alias(key)).distinct()


def lineage_exists(docs: DataFrame, hops: Sequence[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """docs with used: whether a chain of hops (frame, from, to) leads on from each. Walked from the far end, by semi joins."""
    ends: DataFrame | None = None
    for df, src, dst in reversed(hops):
        step = df if ends is None else df.join(ends.withColumnRenamed("_id", dst), dst, "left_semi")
        ends = step.select(F.col(src).alias("_id")).where("_id IS NOT NULL").distinct()
    return docs.join(ends.select(F.col("_id").alias(key), F.lit(True).alias("used")), key, "left").withColumn("used", F.coalesce("used", F.lit(False)))


def event_times(events: DataFrame, lineage: DataFrame, sidecar: DataFrame, event: str = "event_id", doc: str = "doc_id", ts: str = "ts", known: str = "available_at") -> DataFrame:
    """events with event_time: the earliest time that the sidecar has for a document behind the event, else when it was known."""
    best = lineage.join(sidecar, doc).groupBy(event).agg(F.min(ts).alias("_t"))
    return events.join(best, event, "left").withColumn("event_time", F.coalesce("_t", known)).withColumn("promoted", F.col("_t").isNotNull()).drop("_t")


def event_contexts(events: DataFrame, arguments: DataFrame, titles: DataFrame, entities: DataFrame, event: str = "event_id", entity: str = "entity_id", role: str = "role", order: str = "published") -> DataFrame:
    """Events that touch any of the entities, with one title each (the earliest) and their arguments as an ordered list."""
    touched = events.join(arguments.join(entities, entity, "left_semi").select(event), event, "left_semi")
    listed = arguments.groupBy(event).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", role, F.col(entity).cast("string")))), ";").alias("arguments"))
    title = titles.groupBy(event).agg(F.min_by("title", F.struct(order, "title")).alias("title"))
    return touched.join(title, event, "left").join(listed, event, "left")


def event_arguments_list(arguments: DataFrame, event: str = "event_id", role: str = "role", name: str = "name") -> DataFrame:
    """role=name of each event, in order."""
    return arguments.groupBy(event).agg(F.array_sort(F.collect_list(F.concat_ws("=", role, F.col(name).cast("string")))).alias("arguments"))


def thread_history(events: DataFrame, ids: DataFrame, event: str = "event_id", thread: str = "thread_id", ts: str = "ts", limit: int = 5) -> DataFrame:
    """The newest other events of the given events' threads."""
    threads = events.join(ids, event, "left_semi").select(thread).distinct()
    others = events.join(threads, thread, "left_semi").join(ids, event, "left_anti")
    return others.withColumn("nth", F.row_number().over(Window.partitionBy(thread).orderBy(F.desc(ts), F.desc(event)))).where(F.col("nth") <= limit)


def member_news(contributions: DataFrame, events: DataFrame, top: int, per: int, fund: str = "fund", member: str = "constituent", value: str = "contribution", entity: str = "entity_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """The first `per` events of each fund's `top` contributors."""
    k = F.row_number().over(Window.partitionBy(fund).orderBy(F.abs(value).desc(), member))
    best = contributions.withColumn("rank", k).where(F.col("rank") <= top).select(fund, member, "rank")
    n = F.row_number().over(Window.partitionBy(entity).orderBy(ts, event))
    first = events.withColumn("nth", n).where(F.col("nth") <= per)
    return best.join(first, best[member] == first[entity]).drop(entity)


def fanout_deliveries(results: DataFrame, tenants: DataFrame, deliveries: DataFrame, result: str = "result_id", tenant: str = "tenant_id", cursor: str = "cursor", max_tenants: int = 10_000) -> DataFrame:
    """A delivery of each new result to every tenant, numbered on from the tenant's last one. Tenants are a bounded list, whose size is checked."""
    if tenants.limit(max_tenants + 1).count() > max_tenants:
        raise ValueError(f"more than {max_tenants} tenants")
    new = results.join(deliveries.select(result).distinct(), result, "left_anti")
    last = deliveries.groupBy(tenant).agg(F.max(cursor).alias("_last"))
    pairs = new.withColumn(tenant, F.explode(F.array_sort(F.lit([r[0] for r in tenants.select(tenant).distinct().collect()]))))
    n = F.row_number().over(Window.partitionBy(tenant).orderBy(result))
    return pairs.withColumn("_n", n).join(last, tenant, "left").withColumn(cursor, F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_last", "_n")


def invalidate_deliveries(withdrawn: DataFrame, deliveries: DataFrame, result: str = "result_id", tenant: str = "tenant_id", cursor: str = "cursor") -> DataFrame:
    """Withdrawal rows for the tenants that got the results, numbered on from each one's last delivery."""
    sent = deliveries.join(withdrawn.select(result).distinct(), result, "left_semi").select(result, tenant).distinct()
    last = deliveries.groupBy(tenant).agg(F.max(cursor).alias("_last"))
    n = F.row_number().over(Window.partitionBy(tenant).orderBy(result))
    return sent.withColumn("_n", n).join(last, tenant).select(result, tenant, (F.col("_last") + F.col("_n")).alias(cursor))


def null_safe_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """left with `take` of the last right row whose keys are not distinct from its own: nulls match nulls."""
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_r"))
    a, b = left.alias("a"), last.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left").select("a.*", *[F.col(f"b._r.{c}").alias(c) for c in take])


def tolerance_match(measures: DataFrame, facts: DataFrame, by: str, tol: float = 0.08, days: int = 7, measure: str = "measure_id", fact: str = "fact_id") -> DataFrame:
    """Each measure with its fact if exactly one of its issuer is within tol of its amount and so many days; several: ambiguous; none: unmatched."""
    f = facts.select(by, F.col(fact).alias("_f"), F.col("amount").alias("_a"), F.col("d").alias("_d"))
    near = (F.abs(F.col("amount") - F.col("_a")) <= tol * F.abs("_a")) & (F.abs(F.date_diff("d", "_d")) <= days)
    found = measures.join(f, by).where(near).groupBy(measure).agg(F.countDistinct("_f").alias("n"), F.min("_f").alias("_f"))
    out = measures.join(found, measure, "left").withColumn("status", F.when(F.col("n").isNull(), "UNMATCHED").when(F.col("n") == 1, "MATCHED").otherwise("AMBIGUOUS"))
    return out.withColumn(fact, F.when(F.col("n") == 1, F.col("_f"))).drop("_f", "n")


def resolve_entities(mentions: DataFrame, entities: DataFrame, mention: str = "mention", name: str = "name", entity: str = "entity_id") -> DataFrame:
    """mentions with entity and status: RESOLVED by exact name with white space normalised, AMBIGUOUS where two entities share it, else UNRESOLVED."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c)), r"\s+", " "))
    keys = entities.groupBy(norm(name).alias("_k")).agg(F.countDistinct(entity).alias("_n"), F.min(entity).alias("_e"))
    out = mentions.withColumn("_k", norm(mention)).join(keys, "_k", "left")
    status = F.when(F.col("_n").isNull(), "UNRESOLVED").when(F.col("_n") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return out.withColumn("status", status).withColumn(entity, F.when(F.col("_n") == 1, F.col("_e"))).drop("_k", "_n", "_e")


def resolve_by_role(mentions: DataFrame, registry: DataFrame, entities: DataFrame, registry_roles: Sequence[str], concept_roles: Sequence[str], role: str = "role", mention: str = "mention") -> DataFrame:
    """Mentions by role: registry roles are looked up there, concept roles get an id from their text, others go to the entities' names."""
    from marketlens.functions.scalar import stable_id

    out = resolve_entities(mentions.join(registry.select(F.col("name").alias(mention), F.col("registry_id")), mention, "left"), entities)
    is_reg, is_concept = F.col(role).isin(list(registry_roles)), F.col(role).isin(list(concept_roles))
    ident = F.when(is_reg, F.col("registry_id").cast("string")).when(is_concept, stable_id("concept_", F.lower(F.trim(mention)))).otherwise(F.col("entity_id").cast("string"))
    status = F.when(is_reg, F.when(F.col("registry_id").isNotNull(), "REGISTRY_HIT").otherwise("REGISTRY_MISS")).when(is_concept, "CONCEPT").otherwise(F.col("status"))
    return out.withColumn("resolved", ident).withColumn("status", status).drop("registry_id", "entity_id")


def calendar_spine(df: DataFrame, d0: date, d1: date, day: str, zeros: Sequence[str]) -> DataFrame:
    """A row for every day of [d0, d1], with zeros where df has none."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(d0), F.lit(d1))).alias(day))
    return days.join(df, day, "left").fillna(0, list(zeros))


def boundary_anti(results: DataFrame, deliveries: DataFrame, result: str = "result_id") -> DataFrame:
    """One row: published but not delivered; delivered, no longer published and not withdrawn."""
    pub = results.where("status = 'PUBLISHED'").select(result).distinct()
    sent = deliveries.groupBy(result).agg(F.max(F.col("withdrawn").cast("int")).alias("_w"))
    a = pub.join(sent, result, "left_anti").agg(F.count("*").alias("undelivered"))
    b = sent.where("_w = 0").join(pub, result, "left_anti").agg(F.count("*").alias("orphaned"))
    return a.join(F.broadcast(b))  # a row each


def missing_expected(expected: DataFrame, loaded: DataFrame, key: Sequence[str], dims: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """Expected rows that were not loaded, with what the dimensions know of them."""
    out = expected.join(loaded.select(*key).distinct(), list(key), "left_anti")
    for df, on in dims:
        out = out.join(df, on, "left")
    return out


def novelty(events: DataFrame, identity: Sequence[str], stages: Mapping[str, int], ts: str = "ts", event: str = "event_id", stage: str = "stage", correction: str = "is_correction") -> DataFrame:
    """Each event's novelty in its thread (events of equal identity, by time): UNKNOWN without a full identity, FIRST,
    CORRECTION, FOLLOW_UP_STAGE if it is further than all before, else DUPLICATE_REBROADCAST."""
    known = F.lit(True)
    for c in identity:
        known = known & F.col(c).isNotNull()
    rank = F.coalesce(*[F.when(F.col(stage) == s, n) for s, n in stages.items()], F.lit(0))
    w = Window.partitionBy(*identity).orderBy(ts, event)
    best = F.max("_rank").over(w.rowsBetween(Window.unboundedPreceding, -1))
    what = F.when(~known, "UNKNOWN").when(F.col("_nth") == 1, "FIRST").when(F.col(correction), "CORRECTION").when(F.col("_rank") > F.col("_best"), "FOLLOW_UP_STAGE").otherwise("DUPLICATE_REBROADCAST")
    return events.withColumn("_rank", rank).withColumn("_nth", F.row_number().over(w)).withColumn("_best", best).withColumn("novelty", what).drop("_rank", "_nth", "_best")


def thread_state_counts(events: DataFrame, by: Sequence[str] = ("event_type", "stage", "novelty")) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"))


def link_counts(edges: DataFrame, top: int, entity: str = "src") -> DataFrame:
    """The link types of each entity with the most related ones."""
    n = edges.groupBy(entity, "link_type").agg(F.countDistinct("dst").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("n"), "link_type"))).where(F.col("rank") <= top)


def event_type_screen(events: DataFrame, prefixes: Sequence[str], min_days: int, top: int, day: Column, type_col: str = "event_type") -> DataFrame:
    """The types, of the prefixes, that occur on the most days, at least min_days."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.startswith(F.col(type_col), F.lit(p))
    return events.where(wanted).groupBy(type_col).agg(F.countDistinct(day).alias("n_days")).where(F.col("n_days") >= min_days).orderBy(F.desc("n_days"), type_col).limit(top)


def event_slot_menu(events: DataFrame, slots: Sequence[str], min_n: int, top: int, type_col: str = "event_type") -> DataFrame:
    """For each type and slot, the values seen at least min_n times, the top most frequent."""
    long = events.select(type_col, *[F.col(s).cast("string").alias(s) for s in slots]).unpivot([type_col], list(slots), "slot", "slot_value").where("slot_value IS NOT NULL")
    n = long.groupBy(type_col, "slot", "slot_value").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(type_col, "slot").orderBy(F.desc("n"), "slot_value"))).where(F.col("rank") <= top)


def event_object_set(events: DataFrame, since: date, day: date, limit: int, entity: str = "entity_id", thread: str = "thread_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """Events of each entity in (since, day], without re-broadcasts, the first of each thread, the earliest `limit`."""
    own = events.where((F.to_date(ts) > F.lit(since)) & (F.to_date(ts) <= F.lit(day)) & (F.col("novelty") != "DUPLICATE_REBROADCAST"))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(entity, thread).orderBy(ts, event))).where("_n = 1").drop("_n")
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(entity).orderBy(ts, event))).where(F.col("nth") <= limit)


def title_duplicates(docs: DataFrame, partition: str, title: str, key: str) -> DataFrame:
    """Titles, white space and case aside, that several ids of a partition have."""
    norm = F.lower(F.trim(F.regexp_replace(F.col(title), r"\s+", " ")))
    return docs.groupBy(partition, norm.alias("norm_title")).agg(F.countDistinct(key).alias("n_ids"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).where("n_ids > 1")


def cohort_funnel(triggers: DataFrame, stages: Sequence[tuple[str, DataFrame]], key: str, lane: str) -> DataFrame:
    """By lane: distinct members of the cohort, and how many reached each stage, in turn."""
    out = triggers.select(key, lane).distinct()
    reached = F.lit(True)
    aggs = [F.countDistinct(key).alias("triggered")]
    for name, df in stages:
        out = out.join(df.select(key, F.lit(True).alias(f"_{name}")).distinct(), key, "left")
        reached = reached & F.col(f"_{name}").isNotNull()
        aggs.append(F.countDistinct(F.when(reached, F.col(key))).alias(name))
    return out.groupBy(lane).agg(*aggs)


def trend_funnel(triggers: DataFrame, stages: Sequence[tuple[str, DataFrame]], key: str, day: str, d0: date, d1: date) -> DataFrame:
    """The funnel per day of [d0, d1], days without triggers included."""
    return calendar_spine(cohort_funnel(triggers, stages, key, day), d0, d1, day, ["triggered", *[n for n, _ in stages]])
