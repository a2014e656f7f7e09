"""Near-duplicates by similarity: rows whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The search is exact, up to equal 64-bit hashes. Sets that share 0.8 have a shingle in common among the first n - ceil(0.8 n) + 1
of each, in any order that is one for all; so rows meet by those prefixes. Shingles that are frequent in a sample, of one
row in EVERY, come last in that order, which decides only how many rows meet, not which are linked. What is known of them
has a fixed size: counts of the most frequent, and a Bloom filter of all; one that is full tells them apart no more, but
loses no link. Rows with equal
sets count as one.

First come the links of SimHash fingerprints of the same shingles, by the vantage-point trees of op4 (see simhash): rows of
equal or linked fingerprints are candidates, and the sets decide. Fingerprints alone would lose most pairs of just 0.8, so
what they don't link is found by the prefixes.

Rows that meet are compared in two rounds, so that a large group of copies doesn't give all its pairs. First each is
paired with a leader; pairs that hold, of these and of the fingerprints, make components. Then rows are compared across components, inside tasks that tell
only links which join components, fewer than there are rows. Both rounds leave out only pairs that can't reach 0.8, by
their sizes and by their parities: sets differ in at least as many shingles as their parity bits differ. What is left is
decided by the sets themselves.

No group meets in one task: one of more than GROUP rows is dealt in blocks. Its first row goes to every block, where it is
the first leader; in a round between the two, one row of each component stands for it in its group, so that components that
only blocks keep apart are joined. The last round compares each two blocks in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, keyed, of_ids, small_batches, written
from .simhash import components, links, shingle_hashes

SIZE = 5
#: Shingles are counted for the order in one of so many rows.
EVERY = 16
#: Shingles found in so many of those come last; so many of them are held with their counts, all in a filter of 2**BLOOM_BITS bits.
FREQUENT, HELD, BLOOM_BITS = 3, 100_000, 26
PARITY = 512
#: Rows of a group that one task compares with one another, or with as many, about.
GROUP = 2_048
#: Shingles of rows that one task compares by their sets, or twice as many, about.
HELD_SHINGLES = 1 << 20


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text, SIZE), dtype=np.uint64))


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number: bits set in over half of their hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def _mapped(df: DataFrame, schema: str, names: list[str], f) -> DataFrame:
    """Rows (uid, *f(shingles of text)) for df's uid and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, 1 << 20):
                rows = [f(shingles(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=names)

    return df.select("uid", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Order:
    """What is known of how frequent shingles are: counts of the most frequent ones (sorted hashes), and a Bloom filter of all that were found often."""

    held: np.ndarray
    counts: np.ndarray
    bits: np.ndarray

    def rarity(self, own: np.ndarray) -> np.ndarray:
        """A number for each shingle, the same wherever it stands: 0 if rare."""
        word, bit = _places(own)
        n = np.logical_and.reduce([self.bits[w] >> b & 1 for w, b in zip(word, bit, strict=True)]).astype(np.int64)
        if len(self.held):
            at = np.minimum(np.searchsorted(self.held, own), len(self.held) - 1)
            n = np.where(self.held[at] == own, self.counts[at], n)
        return n


def _places(own: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The words and bits of a Bloom filter at which shingles' marks are: four each, of different parts of the hash."""
    at = [(own * np.uint64(m)) >> np.uint64(64 - BLOOM_BITS) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    return [(x >> np.uint64(6)).astype(np.int64) for x in at], [x & np.uint64(63) for x in at]


def frequent(own: DataFrame, every: int = EVERY) -> Order:
    """How frequent shingles are in every so-manieth row: the sample grows with the rows, so that shingles of some tens of rows are told from rarer ones at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1, 4 << 20):
                found = [shingles(t) for t in part.column(1).to_pylist()]
                one, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    drawn = own.select("uid", "text").where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0)
    counts = written(drawn.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT))
    rows = counts.orderBy(F.desc("n"), "h").limit(HELD).collect()
    held = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(held)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bits = _places(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
            places = np.unique(np.concatenate([w << 6 | b.astype(np.int64) for w, b in zip(words, bits, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array(np.left_shift(np.uint64(1), (places & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    # At most as many rows as the filter has words.
    words = counts.select("h").mapInArrow(marked, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Order(held[order], np.array([r.n for r in rows], dtype=np.int64)[order], bits)


def prefix(own: np.ndarray, order: Order) -> np.ndarray:
    """The shingles of which two sets that share 0.8 have one in common: the rarest, then by hash."""
    return own[np.lexsort((own, order.rarity(own)))[: len(own) - (4 * len(own) + 4) // 5 + 1]] if len(own) else own


def parity(own: np.ndarray, bits: int = PARITY) -> bytes:
    """For each of bits remainders, whether the number of shingles with it is odd."""
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) % 2 == 1).tobytes()


def wide_parity(own: np.ndarray) -> bytes:
    """Parities of two to four bits a shingle, of which a longer one folds to a shorter."""
    return parity(own, max(PARITY, 1 << (2 * len(own) - 1).bit_length()) if len(own) else PARITY)


def apart(x: bytes, y: bytes) -> int:
    """Parity bits in which two sets differ, in the shorter's length."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _may(n: np.ndarray, bits: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Whether row a and each of rows b can share 0.8."""
    fits = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
    return fits & (9 * np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1, dtype=np.int64) <= n[a] + n[b])


def _dealt(met: DataFrame, across: bool, most: int) -> DataFrame:
    """met with i, j, own: the blocks that a task compares, and the row's. Blocks of a group by themselves, each with its first row; or each two."""
    n = F.ceil(F.col("size") / most).cast("int")
    dealt = met.withColumn("own", F.pmod(F.xxhash64("uid"), n).cast("int"))
    all_ = F.sequence(F.lit(0), n - 1)
    if not across:
        return dealt.withColumn("i", F.explode(F.when(F.col("uid") == F.col("low"), all_).otherwise(F.array("own")))).withColumn("j", F.col("i"))
    return dealt.withColumn("other", F.explode(all_)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _led(met: DataFrame, most: int = GROUP) -> DataFrame:
    """a, b (a < b): rows of a group (met: g, size, low, uid, n, parity) that can share 0.8 with a leader of their block, and the leader. size: the group's rows, low: the least uid."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("uid").to_numpy())
        uid, n = (rows.column(c).to_numpy()[order] for c in ("uid", "n"))
        bits = np.frombuffer(b"".join(rows.column("parity").to_pylist()), dtype=np.uint64).reshape(len(uid), -1)[order]
        one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        left = np.arange(len(uid))
        while len(left) > 1:
            first, left = left[0], left[1:]
            near = left[_may(n, bits, first, left)]
            one.append(np.full(len(near), uid[first], np.int64))
            two.append(uid[near])
            left = np.setdiff1d(left, near, assume_unique=True)
        return pa.table({"a": np.concatenate(one), "b": np.concatenate(two)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return _dealt(met, False, most).select("g", "i", "j", "uid", "n", "parity").groupBy("g", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _printed(least: DataFrame) -> DataFrame:
    """a, b (a < b): rows (low, fp) whose fingerprints are equal, or linked over vantage-point trees, with one that stands for each. Fewer pairs than rows connect them all."""
    prints = written(least.groupBy("fp").agg(F.min("low").alias("first")))
    same = least.join(prints, "fp").where("low > first").select(F.col("first").alias("a"), F.col("low").alias("b"))
    one, two = (prints.select(F.col("fp").alias(c), F.col("first").alias(f"first{c}")) for c in "ab")
    near = links(prints.select("fp")).join(one, "a").join(two, "b")
    return same.union(near.select(F.least("firsta", "firstb"), F.greatest("firsta", "firstb")))


def _joining(uid: np.ndarray, root: np.ndarray, n: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of links that join roots of rows whose sets (n values each, one after the other) share 0.8: fewer links than roots, and any two roots with a link between their rows are connected."""
    _, codes = np.unique(values, return_inverse=True)
    _, label = np.unique(root, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)))
    mark = np.zeros(len(codes), np.int32)
    one, two = [], []
    for a in range(len(uid) - 1):
        if (label[a + 1 :] == label[a]).all():
            continue
        mark[codes[starts[a] : starts[a + 1]]] = 1
        both = np.add.reduceat(mark[codes[starts[a + 1] :]], starts[a + 1 : -1] - starts[a + 1])
        mark[codes[starts[a] : starts[a + 1]]] = 0
        b = a + 1 + np.flatnonzero((9 * both >= 4 * (n[a] + n[a + 1 :])) & (label[a + 1 :] != label[a]))
        for other, k in zip(*np.unique(label[b], return_index=True), strict=True):
            one.append(uid[a])
            two.append(uid[b[k]])
            label[label == other] = label[a]
    return one, two


def _across(own: DataFrame, met: DataFrame, most: int = GROUP, most_held: int = HELD_SHINGLES) -> DataFrame:
    """a, b: links between rows of a group (met, with root) that join all roots between which there are links; no pairs leave a task.

    By their parities first, then by wide ones: a row that can't share 0.8 with one of another root is left out. What is
    left goes to a task for each set of rows, whichever groups they meet in; so few sets travel.
    """

    def near(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("uid").to_numpy())
        uid, n, root, block = (rows.column(c).to_numpy()[order] for c in ("uid", "n", "root", "own"))
        bits = np.frombuffer(b"".join(rows.column("parity").to_pylist()), dtype=np.uint64).reshape(len(uid), -1)[order]
        two_blocks = key[1].as_py() != key[2].as_py()
        some = np.zeros(len(uid), bool)
        for k in range(len(uid) - 1):
            other = k + 1 + np.flatnonzero(root[k + 1 :] != root[k])
            other = other[block[other] != block[k]] if two_blocks else other
            other = other[_may(n, bits, k, other)]
            some[other] = True
            some[k] |= len(other) > 0
        rest = np.flatnonzero(some)
        part = (np.cumsum(n[rest]) - n[rest]) // most_held
        parts = np.unique(part)
        out = []
        for x in range(len(parts)):
            for y in range(x + 1, len(parts)) if len(parts) > 1 else [x]:
                here = rest[(part == parts[x]) | (part == parts[y])]
                k = np.array([xxhash.xxh3_64_intdigest(uid[here].tobytes())], np.uint64).view(np.int64)[0]
                out.append(pa.table({"k": np.full(len(here), k), "uid": uid[here], "root": root[here]}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("k", "uid", "root")})

    def nearer(rows: pa.Table) -> pa.Table:
        uid, at = np.unique(rows.column("uid").to_numpy(), return_index=True)
        root, n = (rows.column(c).to_numpy()[at] for c in ("root", "n"))
        wide = [x.as_py() for x in rows.column("w").take(pa.array(at))]
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, PARITY // 64), axis=0) for x in wide])
        some = np.zeros(len(uid), bool)
        for a in range(len(uid) - 1):
            b = a + 1 + np.flatnonzero((root[a + 1 :] != root[a]) & ~(some[a] & some[a + 1 :]))
            for k in b[_may(n, bits, a, b)]:
                if not (some[a] and some[k]) and 9 * apart(wide[a], wide[k]) <= n[a] + n[k]:
                    some[a] = some[k] = True
        k = np.array([xxhash.xxh3_64_intdigest(uid[some].tobytes())], np.uint64).view(np.int64)[0]
        return pa.table({"k": np.full(int(some.sum()), k), "uid": uid[some], "root": root[some]})

    def linked(rows: pa.Table) -> pa.Table:
        uid, at = np.unique(rows.column("uid").to_numpy(), return_index=True)
        sets = rows.column("w").combine_chunks().take(pa.array(at))
        n = sets.value_lengths().to_numpy().astype(np.int64)
        one, two = _joining(uid, rows.column("root").to_numpy()[at], n, sets.flatten().to_numpy())
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    columns = ["g", "i", "j", "own", "uid", "n", "parity", "root"]
    few = written(_dealt(met, True, most).select(columns).groupBy("g", "i", "j").applyInArrow(near, "k long, uid long, root long").distinct())
    wide = written(_mapped(of_ids(own, few, "left_semi"), "uid long, n long, w binary", ["uid", "n", "w"], lambda s: (len(s), wide_parity(s))))
    few = written(few.join(wide, "uid").groupBy("k").applyInArrow(nearer, "k long, uid long, root long").distinct())
    sets = written(_mapped(of_ids(own, few, "left_semi"), "uid long, w array<long>", ["uid", "w"], lambda s: (s.view(np.int64),)))
    return few.join(sets, "uid").groupBy("k").applyInArrow(linked, "a long, b long").distinct()


def alike(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b of uids whose sets share 0.8: 9 |A and B| >= 4 (|A| + |B|). Wide parities go first, so that few sets travel."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, x, y = (c.to_pylist() for c in batch.columns)
            keep = [9 * apart(x[k], y[k]) <= n[k] for k in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def joined(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        one, two = (rows.select(F.col("uid").alias(c), F.col("n").alias(f"n{c}"), F.col("w").alias(f"w{c}")) for c in "ab")
        return pairs.join(one, "a").join(two, "b")

    ids = lambda p: p.select(F.col("a").alias("uid")).union(p.select("b"))
    texts = of_ids(own, ids(pairs), "left_semi")
    wide = written(_mapped(texts, "uid long, n long, w binary", ["uid", "n", "w"], lambda s: (len(s), wide_parity(s))))
    pairs = written(joined(pairs, wide).selectExpr("a", "b", "na + nb AS n", "wa", "wb").mapInArrow(near, "a long, b long"))
    texts = of_ids(own, ids(pairs), "left_semi")
    sets = written(_mapped(texts, "uid long, n long, w array<long>", ["uid", "n", "w"], lambda s: (len(s), s.view(np.int64))))
    return joined(pairs, sets).where("9 * size(array_intersect(wa, wb)) >= 4 * (na + nb)").select("a", "b")


def groups(own: DataFrame, most: int = GROUP) -> DataFrame:
    """uid, root for each row of own (uid, text): rows have one root if pairs that share 0.8 connect them. Rows without words are alike. most decides how groups are dealt, no result."""
    small_batches(own.sparkSession)
    order = own.sparkSession.sparkContext.broadcast(frequent(own))

    def row(s: np.ndarray) -> tuple:
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), fingerprint(s), parity(s), prefix(s, order.value).view(np.int64)

    seen = written(_mapped(own, "uid long, n long, digest binary, fp long, parity binary, prefix array<long>", ["uid", "n", "digest", "fp", "parity", "prefix"], row))
    least = written(seen.groupBy("digest", "fp").agg(F.min("uid").alias("low")))
    firsts = seen.join(least.select(F.col("low").alias("uid")), "uid", "left_semi")
    # Rows that meet by several shingles are one group: it goes by two hashes of its rows, of which none gathers them.
    h = Window.partitionBy("h")
    same = {"size": F.count("*"), "low": F.min("uid"), "x": F.bit_xor(F.xxhash64("uid")), "y": F.bit_xor(F.xxhash64("uid", F.lit(1)))}
    met = firsts.select("uid", F.explode("prefix").alias("h")).select("uid", *[f.over(h).alias(c) for c, f in same.items()]).where("size > 1").distinct()
    met = written(met.select(F.xxhash64("x", "y", "size", "low").alias("g"), "size", "low", "uid").join(seen.select("uid", "n", "parity"), "uid"))

    def rooted(edges: DataFrame) -> DataFrame:
        return met.join(components(edges).withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))

    # The fingerprints' links first; those of other pairs that share 0.8 follow from the shingles they have in common.
    printed = _printed(least)
    edges = written(alike(own, written(printed.union(_led(met, most)).distinct())))
    if met.where(F.col("size") > most).limit(1).count():
        stand = written(rooted(edges).where(F.col("size") > most).groupBy("g", "root").agg(F.min(F.struct("uid", "n", "parity")).alias("x")).select("g", "root", "x.*"))
        sizes = stand.groupBy("g").agg(F.count("*").alias("size"), F.min("uid").alias("low")).where("size > 1")
        edges = written(edges.union(_across(own, stand.join(sizes, "g"), most)))
    parts = written(rooted(edges))
    mixed = parts.groupBy("g").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("g")
    found = components(edges.union(_across(own, parts.join(mixed, "g", "left_semi"), most)))
    low = least.join(found, least.low == found.node, "left").select("digest", F.coalesce("root", "low").alias("root"))
    return seen.select("uid", "digest").join(low, "digest").select("uid", "root")


def near_duplicates(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its group; null if none has one) of each row of docs (doc_id, text)."""
    own = keyed(docs.select("doc_id", "text"))
    rooted = written(groups(own, most).join(own.select("uid", "doc_id"), "uid"))
    return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first row of each group of docs: the smallest doc_id (null last), then the least text. Each row counts, whether or not its id is null or another's too."""
    own = keyed(docs)
    rooted = written(groups(own))
    several = rooted.groupBy("root").count().where("count > 1").select("root")
    rows = written(rooted.join(several, "root", "left_semi").join(own.select("uid", "doc_id"), "uid"))
    first = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("nth", F.rank().over(first))
    # Texts decide only between rows that share the smallest id; where there are none, none are read.
    best = written(ranked.where("nth = 1"))
    ties = best.join(best.groupBy("root").count().where("count > 1").select("root"), "root", "left_semi")
    texts = of_ids(own.select("uid", "text"), ties, "left_semi")
    chosen = best.join(texts, "uid", "left").groupBy("root").agg(F.min(F.struct("text", "uid")).getField("uid").alias("uid"))
    return of_ids(own, rows.join(chosen, "uid", "left_anti"), "left_anti").select(docs.columns)
