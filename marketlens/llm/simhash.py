"""SimHash near-duplicates over vantage-point trees.

Fingerprints within RADIUS = 3 bits are equal in one of their four 16-bit parts at least. So there are four trees, one per
part, each over the Hamming distance within its part and searched with radius 0. A node keeps a vantage point and a
distance: a fingerprint nearer than that goes left, others right, and by the triangle inequality no link crosses that
bound; each fingerprint goes to four leaves, however deep the trees. Leaves are the shards: each finds its links exactly,
by the distance over all 64 bits. A shard that holds more than FULL fingerprints is split once more by trees over the
other parts, fitted on its own members: links differ by one bit at most in one of those, so these are searched with
radius 1, and what lies within 1 of a bound goes both ways. Beyond BLOCK it is first dealt out in blocks, each pair of
blocks to one task.

The trees are fitted on a bounded sample of fingerprints (SAMPLE), which decides only how evenly shards fill; every
fingerprint is sent down all trees, so links don't depend on the sample. A shard emits stars that connect what is linked,
never all pairs; equal fingerprints meet before, as one. Components are then found by alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, written

RADIUS = 3
#: Fingerprints on which the trees are fitted, at most.
SAMPLE = 65_536
#: Fingerprints that a shard should hold, those from which it is split again, and those that one task takes at most of a block.
SHARD, FULL, BLOCK = 512, 8_192, 131_072

_PARTS = tuple(np.uint64(0xFFFF << k) for k in (48, 32, 16, 0))


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """The XXH64 (seed 42) of all word shingles, repeats included; of fewer words, of all as one. Words are lower-cased (ASCII)."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority bits of the hashes of all word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, size)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, 1 << 20):
                fps = np.array([fingerprint(t, size) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Tree:
    """One vantage-point tree over the bits of mask, searched with a radius. Nodes are in arrays; child >= 0 is a node, else ~child is a leaf."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, shard: float, radius: int = 0, depth: int = 40):
        self.mask, self.radius, self.point, self.bound, self.children, self.leaves = mask, radius, [], [], [], 0
        self.root = self._grow(sample, shard, depth)

    def _leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def _grow(self, members: np.ndarray, shard: float, depth: int) -> int:
        if len(members) <= shard or not depth:
            return self._leaf()
        best = None
        for k in np.linspace(0, len(members) - 1, 5).astype(int):  # the vantage point whose bound leaves the fewest on the fuller side
            d = np.bitwise_count((members ^ members[k]) & self.mask).astype(np.int64)
            for bound in {int(np.median(d)), int(np.median(d)) + 1}:
                left, right = int((d <= bound - 1 + self.radius).sum()), int((d >= bound - self.radius).sum())
                if max(left, right) < len(members) and (best is None or (left + right, max(left, right)) < best[0]):
                    best = ((left + right, max(left, right)), members[k], bound, d)
        if best is None:
            return self._leaf()
        _, point, bound, d = best
        at = len(self.point)
        self.point.append(point)
        self.bound.append(bound)
        self.children.append([0, 0])
        self.children[at] = [self._grow(members[d < bound], shard, depth - 1), self._grow(members[d >= bound], shard, depth - 1)]
        return at

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of fps and the leaves they visit, boundary copies included: those that may hold a fingerprint within the radius."""
        rows_out, leaves_out, work = [], [], [(self.root, np.arange(len(fps)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if node < 0:
                rows_out.append(rows)
                leaves_out.append(np.full(len(rows), ~node, np.int64))
                continue
            d = np.bitwise_count((fps[rows] ^ self.point[node]) & self.mask).astype(np.int64)
            work.append((self.children[node][0], rows[d - self.radius < self.bound[node]]))
            work.append((self.children[node][1], rows[d + self.radius >= self.bound[node]]))
        if not rows_out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _joined(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Joins the groups of each one and two, in place: a label is a group's smallest row number."""
    while True:
        a, b = label[one], label[two]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            short = label[label]
            if (short == label).all():
                break
            label[:] = short


def groups(fps: np.ndarray, radius: int = RADIUS, part: int | None = None, full: int = FULL, tile: int = 1024) -> np.ndarray:
    """For each of distinct fingerprints the smallest row number that links reach. part: the one in which a tree already told them apart; more than full are sent down trees over the others."""
    label = np.arange(len(fps))
    shards = [label]
    if len(fps) > full and part is not None:
        shards = []
        for k, mask in enumerate(_PARTS):
            if k != part:
                tree = Tree(fps[np.linspace(0, len(fps) - 1, min(len(fps), 8 * full)).astype(int)], mask, max(full / 8, 1), radius=1)
                rows, leaves = tree.route(fps)
                order = np.argsort(leaves, kind="stable")
                shards += np.split(rows[order], np.flatnonzero(np.diff(leaves[order])) + 1)
    for own in shards:
        for a in range(0, len(own), tile):
            for b in range(a, len(own), tile):
                i, j = np.nonzero(np.bitwise_count(fps[own[a : a + tile], None] ^ fps[None, own[b : b + tile]]) <= radius)
                _joined(label, own[i + a], own[j + b])
    return label


def links(fps: DataFrame, shard: int = SHARD, sample: int = SAMPLE, full: int = FULL, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of the distinct fp, which connect every pair within RADIUS and nothing else, in the transitive sense."""
    spark = fps.sparkSession
    n = fps.count()
    # A hash order makes the sample the same on every run.
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // sample))) == 0).orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(sample)
    points = np.array([r.fp for r in drawn.collect()], dtype=np.int64).view(np.uint64)
    per = max(1.0, shard * len(points) / max(n, 1))  # of the sample, in a shard
    trees = spark.sparkContext.broadcast([Tree(points, mask, per) for mask in _PARTS])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, tree in enumerate(trees.value):
                rows, leaves = tree.route(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(len(_PARTS) * leaves + k), pa.array(own[rows])], names=["shard", "fp"])

    def match(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.unique(rows.column("fp").to_numpy().astype(np.int64))
        label = groups(own.view(np.uint64), part=key[0].as_py() % len(_PARTS), full=full)
        linked = np.flatnonzero(label != np.arange(len(own)))
        return pa.table({"a": pa.array(own[label[linked]]), "b": pa.array(own[linked])}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    sent = written(fps.select("fp").mapInArrow(send, "shard long, fp long"))
    # Shards are as many as the trees' leaves, a bounded number; those too full for one task are few.
    over = sent.groupBy("shard").count().where(F.col("count") > block).select("shard", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    blocked = sent.join(F.broadcast(over), "shard", "left").withColumn("own", F.expr("IF(blocks IS NULL, 0, pmod(xxhash64(fp), blocks))"))
    dealt = blocked.withColumn("other", F.explode(F.expr("IF(blocks IS NULL, array(0), sequence(0, blocks - 1))")))
    found = dealt.select("shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp").groupBy("shard", "lo", "hi").applyInArrow(match, "a long, b long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) of every node in an edge, by large-star and small-star steps, until nothing changes."""
    now = written(edges.select("a", "b"))
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the least
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(low.select("a", F.col("m").alias("b")))
        now = written(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) for each row of docs.

    Fingerprints of shingles of size words are linked within RADIUS. The pipeline's stage goes by shared shingles: see similar.

    A null or empty text has fingerprint 0 and is linked as any other. Rows that share an id each get a row. A null id
    stays null and is never a component's id unless no other is there. An empty table gives none. Other columns of
    docs are ignored.
    """
    own = written(fingerprints(docs, size))
    least = written(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    joined = components(links(least.select("fp")))
    # Every fingerprint with its root: those without links are roots of their own.
    rooted = least.join(joined, least.fp == joined.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")
