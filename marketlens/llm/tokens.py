"""Token ids in a content-addressed store.

A document's ids, each a little-endian unsigned 16-bit number, are cut into chunks where a rolling hash of the last
ROLL ids says so, so that equal passages give equal chunks wherever they stand. The store has two tables. Chunks: each
distinct chunk once, under its digest. Recipes, in ascending order of documents: the digests that make up a document,
where its ids start in the whole stream, and its Merkle root. Reading back joins recipes with chunks; every chunk is
checked against its digest, and every document's root against its recipe.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, written

ROLL = 8
#: One place in 2**CUT_BITS is a cut, on average; a chunk has MOST ids at most.
CUT_BITS, MOST = 8, 4096
END_ID = 2
#: Distinct pieces of text whose ids a Python worker keeps; others are encoded again when they recur.
KEPT = 800_000
#: Text that is encoded at once.
ENCODED_BYTES = 8 << 20

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
# White space by any definition, for two kinds of patterns.
_WS = r"\p{Z}\s\x0b\x1c-\x1f\x{85}"
#: A space beside other white space, or a NUL: texts that hold one are cut by _GAP.
_ODD = rf"[{_WS}] | [{_WS}]|\x00"
_GAP = re.compile(r"(?<=\S)(?= \S)")
#: Line ends between other characters, of which the last stands alone, and letters before a mark other than the apostrophe.
_LINES = rf"([^{_WS}])(\n*)(\n)([^{_WS}])"
_MARKS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"


class Encoder:
    """Encodes texts with the tokenizers library and a byte-level BPE file, each distinct piece of text once.

    Byte-level pre-tokenizers always cut before a single space that stands between two other characters, around line ends
    between other characters, and between a letter and most marks. So texts are cut there, and the pieces encoded by the
    library; all else stays inside a piece. A text that holds one of the file's added tokens goes to the library whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept as 16-bit numbers")
        self.added = sorted({t.content for t in self.library.get_added_tokens_decoder().values()})
        self.known = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.uint16()))
        self.end = end_id

    def _encoded(self, pieces: list[str]) -> pa.ListArray:
        found = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        return _lists([array("H", x.ids) for x in found])

    def _joined(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """ids, and how many of each text, for texts as lists of their pieces."""
        flat = pieces.flatten()
        ends = pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()
        at, ids = pc.index_in(flat, value_set=self.known), self.ids
        if at.null_count:
            new = flat.filter(pc.is_null(at)).unique()
            ids = pa.concat_arrays([ids, self._encoded(new.to_pylist())])
            at = pc.coalesce(at, pc.add(pc.index_in(flat, value_set=new), pa.scalar(len(self.known), pa.int32())))
            if len(ids) <= KEPT:
                self.known, self.ids = pa.concat_arrays([self.known, new]), ids
        sizes = ids.value_lengths().to_numpy()[at.to_numpy()]
        upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[ends]
        return ids.take(at).flatten().to_numpy(), np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by its end id, and how many each has with it. Null is empty."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) & ~whole
        marked = texts.filter(pa.array(~odd & ~whole))
        for pattern, by in ((_LINES, r"\1\0\2\0\3\0\4"), (_MARKS, r"\1\0\2")):
            marked = pc.replace_substring_regex(marked, pattern, by.replace(r"\0", "\0"))
        flat, sizes = self._joined(pc.split_pattern(pc.replace_substring(marked, " ", "\0 "), "\0"))
        if odd.any() or whole.any():
            more, n = self._joined(pa.array([_GAP.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string())))
            rest = self._encoded(texts.filter(pa.array(whole)).to_pylist())
            both = np.concatenate((sizes, n, rest.value_lengths().to_numpy()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(both))), pa.int32()), pa.array(np.concatenate((flat, more, rest.flatten().to_numpy()))))
            order = np.argsort(np.concatenate((np.flatnonzero(~odd & ~whole), np.flatnonzero(odd), np.flatnonzero(whole))))
            flat, sizes = lists.take(pa.array(order)).flatten().to_numpy(), both[order]
        return np.insert(flat, np.cumsum(sizes), self.end), sizes + 1


def _lists(rows: list[array]) -> pa.ListArray:
    ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.uint16)))


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def cuts(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the chunks of documents end, whose ids (sizes of each, at least one) stand one after another.

    A document's end is a cut. So is a place in it if the low bits of a rolling hash of the ROLL ids before it are 0;
    stretches without one are cut every MOST ids.
    """
    gear, h = _GEAR[ids], np.zeros(len(ids), np.uint64)
    for k in range(min(ROLL, len(ids))):
        h[k:] += gear[: len(ids) - k] << np.uint64(k)
    last = np.cumsum(sizes)
    places = np.flatnonzero((h >> np.uint64(20)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    doc = np.searchsorted(last, places - 1, side="right")
    places = places[(places - (last - sizes)[doc] >= ROLL) & (places < last[doc])]
    ends = np.sort(np.concatenate((places, last)))
    starts = np.concatenate(([0], ends[:-1]))
    long = np.flatnonzero(ends - starts > MOST)
    if len(long):
        ends = np.unique(np.concatenate([ends, *(np.arange(starts[k] + MOST, ends[k], MOST) for k in long)]))
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """The root of the binary tree over the digests, in order; an odd one is carried up. Without any, the digest of nothing."""
    level = list(digests) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


# CRC-32 of joined byte strings from those of the parts: a part's is moved past the bytes after it by multiplying with a power of x.
_POLY = 0xEDB88320


def _shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each crc after n_bytes zero bytes (without the usual conditioning, so that XOR joins the parts)."""
    crc, left = crc.astype(np.uint32), n_bytes.astype(np.int64).copy()
    bits = [_times_x(1 << b) for b in range(32)]  # the image of each bit after one zero bit
    matrix = np.array(bits, np.uint32)
    for _ in range(3):
        matrix = _square(matrix)  # one zero byte
    while left.any():
        odd = (left & 1).astype(bool)
        crc[odd] = _apply(matrix, crc[odd])
        left >>= 1
        matrix = _square(matrix)
    return crc


def _times_x(v: int) -> int:
    return (v >> 1) ^ (_POLY if v & 1 else 0)


def _apply(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for b in range(32):
        out ^= np.where((v >> np.uint32(b)) & np.uint32(1) == 1, matrix[b], np.uint32(0))
    return out


def _square(matrix: np.ndarray) -> np.ndarray:
    return _apply(matrix, matrix)


@dataclass
class Store:
    """chunks: digest, data. recipes: doc_id, part, start, n_tokens, digests (array), sizes (ids of each), root."""

    chunks: DataFrame
    recipes: DataFrame


def stored(docs: DataFrame, path: str, end_id: int = END_ID) -> Store:
    """Encodes every row of docs (doc_id, text) and writes the store's two tables in the shared folder.

    A null or empty text is the end id alone. Rows that share an id follow one another, by text; a null id comes first.
    An empty table gives empty tables. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path, end_id)
        names = ["doc_id", "version", "n_tokens", "digests", "sizes", "root", "datas"]
        for batch in batches:
            for part in blocks(batch, 1, ENCODED_BYTES):
                ids, sizes = own.encode(part.column(1))
                ends, last = cuts(ids, sizes), np.cumsum(sizes)
                joined = memoryview(ids.astype("<u2").tobytes())
                offsets = np.concatenate(([0], 2 * ends)).astype(np.int32)
                places = offsets.tolist()
                digests = [digest(joined[a:b]) for a, b in pairwise(places)]
                first = [0, *np.searchsorted(ends, last, side="right").tolist()]
                roots = [merkle_root(digests[a:b]) for a, b in pairwise(first)]
                lists = pa.array(first, pa.int32())
                columns = [
                    part.column(0),
                    part.column(2),
                    pa.array(sizes.astype(np.int64)),
                    pa.ListArray.from_arrays(lists, pa.array(digests, pa.binary())),
                    pa.ListArray.from_arrays(lists, pa.array(np.diff(offsets) // 2, pa.int32())),
                    pa.array(roots, pa.binary()),
                    pa.ListArray.from_arrays(lists, pa.BinaryArray.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    cut = docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, "doc_id long, version long, n_tokens long, digests array<binary>, sizes array<int>, root binary, datas array<binary>")
    cut = written(cut)
    # Chunks go to the place of their digest once per task at most, then once at all.
    pairs = cut.select(F.explode(F.arrays_zip("digests", "datas")).alias("c")).select("c.digests", "c.datas").toDF("digest", "data")
    chunks = written(pairs.dropDuplicates(["digest"]))
    # Recipes in ascending order: ranges of ids, sorted within; starts from the sizes of the ranges before.
    ordered = cut.select("doc_id", "version", "n_tokens", "digests", "sizes", "root").repartitionByRange("doc_id", "version").sortWithinPartitions("doc_id", "version").withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id())
    ordered = written(ordered)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range, not for each document
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    recipes = ordered.join(F.broadcast(parts), "part").withColumn("start", start).select("doc_id", "part", "nth", "start", "n_tokens", "digests", "sizes", "root")
    return Store(chunks, written(recipes))


def reconstructed(store: Store) -> DataFrame:
    """doc_id, nth, ids (binary, 16-bit numbers) of each recipe, joined from its chunks."""
    pieces = store.recipes.select("doc_id", "nth", F.posexplode("digests").alias("k", "digest"))
    joined = pieces.join(store.chunks, "digest").groupBy("doc_id", "nth").agg(F.array_sort(F.collect_list(F.struct("k", "data"))).alias("x"))
    return joined.select("doc_id", "nth", F.expr("aggregate(x, cast('' AS binary), (a, c) -> concat(a, c.data))").alias("ids"))


def read_back(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document (its ids as 32-bit numbers), from the files.

    Each chunk is read once, checked against its digest, and summed up by its size and CRC-32; a document's CRC follows
    from those of its chunks, in the order of its recipe, so no chunk is sent to each document that holds it. The sizes
    and digests found must give the recipe's, and the digests its Merkle root; else the job fails.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, datas = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(digest(x) != k for k, x in zip(keys, datas, strict=True)):
                raise ValueError("a chunk differs from its digest")
            wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in datas]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 for x in datas], pa.int32()), pa.array([zlib.crc32(x) for x in wide], pa.int64())], names=["digest", "n", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, crc = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.column(5).flatten().flatten())
            lengths = batch.column(5).value_lengths().to_numpy(zero_copy_only=False)
            upto, total = np.cumsum(lengths), np.concatenate(([0], np.cumsum(n)))
            moved = _shifted(crc.astype(np.uint32), 4 * (np.repeat(total[upto], lengths) - total[1:]))
            found = total[upto] - total[upto - lengths]
            digests = batch.column(3).to_pylist()
            same = all(len(d) == k and merkle_root(d) == root for d, k, root in zip(digests, lengths.tolist(), batch.column(4).to_pylist(), strict=True))
            if not same or (found != batch.column(2).to_numpy()).any():
                raise ValueError("a document differs from its recipe")
            crcs = np.bitwise_xor.reduceat(moved, upto - lengths).astype(np.int64) if len(moved) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    known = store.chunks.select("digest", "data").mapInArrow(sums, "digest binary, n int, crc long")
    pieces = store.recipes.select("nth", F.posexplode("digests").alias("k", "digest"))
    met = pieces.join(known, "digest").groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("k", "n", "crc"))).alias("found"))
    whole = store.recipes.join(met, "nth").select("doc_id", "start", "n_tokens", "digests", "root", "found")
    return whole.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
