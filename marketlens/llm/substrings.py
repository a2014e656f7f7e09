"""Substring deduplication by relative Lempel-Ziv parsing over word sequences.

Every document is a reference block for those after it. The index of reference blocks holds phrases, the windows of
WINDOW words, each at its first place in the corpus. Phrases are indexed by an anchor: of a window's ANCHOR-word runs,
the one with the least hash (a minimizer), so that equal windows, wherever they stand, have the same anchor. Anchors
that occur once in the corpus can't start a factor; around the others, documents look up their phrases.

A document is then parsed greedily from left to right: at the next place whose phrase stands in a reference, a factor
begins there and is extended word by word, as long as the next phrase stands at the next place of the same reference.
So a factor is a start, a length of WINDOW words or more, and its source. Phrases that straddle the boundary of two
factors are looked up as any other: where one stands in a third reference it is a factor too. What factors cover is the
duplicate text. A source is the first document with the phrase at hand, so a factor ends where an earlier one takes over.

Documents whose whole text an earlier one has are one factor each, and are told by hashes of the texts; they are left out
of the index. Which anchors repeat reaches the tasks as a Bloom filter of fixed size (FILTER_BITS), so what is broadcast doesn't grow
with the corpus. Its false positives cost lookups, never results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, written

WINDOW = 20
ANCHOR = 8
FILTER_BITS = 1 << 27
#: Places for the keys of whole copies, which need no parsing.
SLOTS = 1 << 20
#: Tasks among which the copies of one text are dealt.
SALTS = 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolled(hashes: np.ndarray, size: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """A hash of each run of size words."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * odd + hashes[k : k + n]
    return _mix(out)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrase hashes, and for each window the place of its anchor among them (the leftmost of the least)."""
    phrases = _rolled(hashes, anchor)
    own = np.lib.stride_tricks.sliding_window_view(phrases, window - anchor + 1)
    return phrases, own.argmin(axis=1) + np.arange(len(own))


def _texts(part: pa.RecordBatch, at: int) -> list[list[bytes]]:
    return [x.encode().split() if x else [] for x in part.column(at).to_pylist()]


def repeated_anchors(docs: DataFrame, skip, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """anchor: the hashes that occur at two places or more. docs: key, text; skip: a broadcast table of keys left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 1):
                found = []
                for out, words in zip(_holds(skip.value, part.column(0)), _texts(part, 1), strict=True):
                    if len(words) >= window and not out:
                        phrases, at = _anchors(_word_hashes(words), window, anchor)
                        found.append(phrases[np.unique(at)])
                if found:
                    own, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return docs.select("key", "text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, key, source: the rows of docs (key, doc_id, text) whose whole text a row of smaller id, source, has too."""
    sums = written(docs.select("key", "doc_id", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), F.octet_length("text").alias("n"), F.pmod("key", F.lit(SALTS)).alias("salt")))
    first = sums.groupBy("a", "b", "n").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    # A text with very many copies meets them in SALTS tasks.
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return written(sums.join(spread, ["a", "b", "n", "salt"]).where("doc_id > source").select("doc_id", "key", "source"))


def _slots(keys: DataFrame, slots: int) -> np.ndarray:
    """A table of at most `slots` of the keys, each at the place its low bits name. A key that finds its place taken is left out, which costs time only."""
    got = keys.groupBy(F.expr(f"key & {slots - 1}L").alias("slot")).agg(F.max("key").alias("key")).toArrow()
    out = np.zeros(slots, np.int64)
    out[got.column("slot").to_numpy()] = got.column("key").to_numpy()
    return out


def _holds(table: np.ndarray, keys: pa.Array) -> list[bool]:
    own = keys.to_numpy(zero_copy_only=False)
    return ((table[own & (len(table) - 1)] == own) & (own != 0)).tolist()


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter (two bits a hash) as words of 64 bits: at most bits / 64 rows come to the driver."""
    places = hashes.select(F.explode(F.array(F.col("anchor"), F.shiftright("anchor", 29))).alias("h")).select(F.expr(f"h & {bits - 1}L").alias("bit"))
    rows = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("ones"))
    got = rows.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("ones").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _may_hold(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(held) * 64 - 1)
    signed = hashes.view(np.int64)
    out = np.ones(len(hashes), bool)
    for h in (signed, signed >> 29):
        bit = h.view(np.uint64) & mask
        out &= (held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def _kept(words: list[bytes], removed: np.ndarray) -> tuple[int, bytes]:
    """How many words go, and the others joined."""
    return int(removed.sum()), b" ".join([w for w, r in zip(words, removed.tolist(), strict=True) if not r])


def _parsed(place: np.ndarray, key: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The greedy parse: which of the places, in order, begin a factor, and the factors' lengths. key, at: where each place's phrase stands first."""
    goes_on = (np.diff(place) == 1) & (np.diff(at) == 1) & (key[1:] == key[:-1])
    begins = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    return begins, np.diff(np.append(begins, len(place))) + window - 1


def factored(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), factors of each row of docs.

    factors: an array of start, length, source (a doc_id), source_start, in words. A word goes if a factor covers it, that
    is, if a window that covers it has its words at an earlier start too: in a document of smaller id, or earlier in the
    same one. Null and empty texts, and those of fewer words than a window, keep all they have. A null id counts as the
    smallest. Rows that share an id are no earlier than each other. An empty table gives none. Other columns of docs are
    ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    whole = copies(docs)
    skip = spark.sparkContext.broadcast(_slots(whole, SLOTS))
    held = spark.sparkContext.broadcast(_filter(repeated_anchors(docs, skip, window, anchor), bits))

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each phrase to look up, with two hashes, and the first place in its document where it stands too (at = place there)."""
        for batch in batches:
            for part in blocks(batch, 2):
                keys, ids, h1, h2, places, firsts = [], [], [], [], [], []
                for key, doc, out, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _holds(skip.value, part.column(0)), _texts(part, 2), strict=True):
                    if len(words) < window or out:
                        continue
                    hashes = _word_hashes(words)
                    phrases, at = _anchors(hashes, window, anchor)
                    own = np.flatnonzero(_may_hold(held.value, phrases)[at])
                    if not len(own):
                        continue
                    one = _rolled(hashes, window)[own]
                    two = _rolled(hashes, window, np.uint64(0xD6E8FEB86659FD93))[own] >> np.uint64(33)
                    _, first, which = np.unique(one, return_index=True, return_inverse=True)
                    keys.append(np.full(len(own), key, np.int64))
                    ids.append(np.full(len(own), doc, np.int64))
                    h1.append(one.view(np.int64))
                    h2.append(two.astype(np.int32))
                    places.append(own.astype(np.int32))
                    firsts.append(own[first[which]].astype(np.int32))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, h1, h2, places, firsts)], names=["key", "doc_id", "h1", "h2", "place", "at"])

    phrases = written(docs.select("key", "doc_id", "text").mapInArrow(lookups, "key long, doc_id long, h1 long, h2 int, place int, at int"))
    own = phrases.where("at = place")
    index = own.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "key", "place")).alias("x"))
    found = "struct(place, source_key, source, at) AS x"
    across = own.drop("at").join(index, ["h1", "h2"]).where("doc_id > x.doc_id").selectExpr("doc_id", "key", "place", "x.key AS source_key", "x.doc_id AS source", "x.place AS at")
    # A phrase that stood earlier in its document needs no lookup; a copy is one factor from end to end.
    within = phrases.where("at < place").selectExpr("doc_id", "key", "place", "key AS source_key", "doc_id AS source", "at")
    ends = whole.selectExpr("doc_id", "key", "-1 AS place", "key AS source_key", "source", "0 AS at")
    runs = across.union(within).union(ends).selectExpr("doc_id", "key", found).groupBy("doc_id", "key").agg(F.collect_set("x").alias("found"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in blocks(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([squeeze((t or "").encode()) for t in part.column(2).to_pylist()], pa.binary())], names=["key", "doc_id", "packed"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in blocks(batch, 1, 1 << 20):
                out, factors, ends = [], [], []
                counts = pa.compute.fill_null(pa.compute.list_value_length(part.column(2)), 0).to_numpy()
                place, key, source, at = (x.to_numpy() for x in part.column(2).flatten().flatten())
                upto = np.concatenate(([0], np.cumsum(counts)))
                for k, (doc, data) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    words = open_(data).split()
                    rows = upto[k] + np.argsort(place[upto[k] : upto[k + 1]], kind="stable")
                    edge = np.zeros(len(words) + 1, np.int64)
                    if len(rows) and place[rows[0]] < 0:
                        rows, sizes = rows[:1], np.array([len(words)])
                        start = np.zeros(1, np.int64)
                    elif len(rows):
                        # A place found in two ways counts once.
                        rows = rows[np.unique(place[rows], return_index=True)[1]]
                        begins, sizes = _parsed(place[rows], key[rows], at[rows], window)
                        rows = rows[begins]
                        start = place[rows].astype(np.int64)
                    else:
                        sizes = start = np.empty(0, np.int64)
                    if len(words) >= window:
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + sizes, -1)
                        factors.append((start, sizes, source[rows], at[rows]))
                    ends.append(len(start) if len(words) >= window else 0)
                    n, kept = _kept(words, np.cumsum(edge[:-1]) > 0)
                    out.append((doc, len(words), n, kept.decode()))
                starts, sizes, sources, places = (np.concatenate(x) if factors else np.empty(0, np.int64) for x in (zip(*factors, strict=True) if factors else [()] * 4))
                named = pa.array(sources.astype(np.int64), mask=sources == -(1 << 63))
                inner = pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32)), named, pa.array(places.astype(np.int32))], names=["start", "length", "source", "source_start"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ends))), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))), lists], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    # Texts travel compressed.
    sent = docs.select("key", "doc_id", "text").mapInArrow(packed, "key long, doc_id long, packed binary")
    schema = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start: int, length: int, source: long, source_start: int>>"
    parsed = sent.join(runs, ["doc_id", "key"], "left").select("doc_id", "packed", "found").mapInArrow(parse, schema)
    return parsed.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def reference(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by brute force, for tests: doc_id to n_words, n_removed and the sha256 of what is kept."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - window + 1):
            own = tuple(words[k : k + window])
            if own in seen:
                gone.update(range(k, k + window))
            seen.add(own)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out
