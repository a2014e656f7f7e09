"""Encoding texts to the pieces of a SentencePiece model, and decoding, by a relational lattice.

A text, with a space put before it, is cut into units: the spaces before a run of letters or of other marks, with that
run, or a line end. They are cut only where no piece of the model crosses, whatever a unit's length, so the best path of
a text is that of its units, joined. A unit's lattice is a table: its bounded-length substrings are exploded and
equi-joined with the piece table; the edges, grouped by unit, are folded by Spark's aggregate() from left to right,
keeping the best path to each place (Viterbi: the largest sum of piece scores; of equal ones, the one whose last piece
is longest). Characters without a piece become byte pieces. Each distinct unit is worked on once.

The HEAD most frequent units, a bounded table, reach the documents by broadcast, so no key of the joins is hot; the
others are sent with the keys of the documents that hold them, and their ids sent back to these.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, small_batches, written

HEAD = 400_000
#: Documents that the head is taken from, at most or little more: it decides only how units reach the documents.
SAMPLE = 100_000
#: Units of more code points go by a digest, never in the head; their substrings are taken from windows of so many.
SHORT = 64
#: Names by which a long unit goes, at most.
SALTS = 256
#: Texts whose keys travel with one unit's lattice, at most.
WHO = 4_096
#: Units that a task keeps count of, and those that it hands on.
TASK_UNITS, TASK_HEAD = 200_000, 100_000
#: Tasks for units, for each of the session's shuffle partitions.
SPREAD = 4
#: Text that is cut into units at once.
CUT_BYTES = 1 << 20
#: The score of a character without a piece: below that of any path over the model's ordinary pieces.
NO_PIECE = -1e8


class Cut(NamedTuple):
    """How texts are cut: a pattern of units, and the same, but for spaces, as replacements that put a NUL at each cut."""

    pattern: regex.Pattern
    marks: tuple[tuple[str, str], ...]


_WORDS = Cut(regex.compile(r" *[^ \n]+| +|\n"), ())
_RUNS = Cut(regex.compile(r" *\p{L}+| *[^\p{L} \n]+| +|\n"), ((r"(\p{L})([^\p{L} \n\x00])", "\\1\0\\2"), (r"([^\p{L} \n\x00])(\p{L})", "\\1\0\\2")))
_CROSSED = regex.compile(r"\p{L}(?=\P{L})|\P{L}(?=\p{L})")
_SPACE = "▁"


def units(text: str | None, cut: Cut = _RUNS) -> list[str]:
    """The units of a text; joined, they are the text with a space before it. An empty or null text has none."""
    return cut.pattern.findall(" " + text) if text else []


def _cut(texts: pa.Array, cut: Cut) -> pa.ListArray:
    """units() of each text, and empty strings, which stand for nothing."""
    texts = pc.fill_null(texts, "")
    marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
    runs = pc.match_substring(texts, "  ")
    spaced = pc.replace_substring(marked, " ", "\0 ")
    if pc.any(runs).as_py():  # only the first space of a run is a cut
        spaced = pc.replace_with_mask(spaced, runs, pc.replace_substring_regex(marked.filter(runs), r"([^ ])( )", "\\1\0\\2"))
    marked = spaced
    for pattern, by in cut.marks:
        marked = pc.replace_substring_regex(marked, pattern, by)
    lists = pc.split_pattern(pc.replace_substring(marked, "\n", "\0\n\0"), "\0")
    nul = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
    if nul.any():  # NUL marks the cuts, so texts that hold one are cut one by one
        own = pa.array([units(t, cut) for t in texts.filter(pa.array(nul)).to_pylist()], pa.list_(pa.string()))
        places = np.arange(len(texts))
        places[nul] = len(texts) + np.arange(len(own))
        lists = pa.concat_arrays([lists, own]).take(pa.array(places))
    return lists


@dataclass
class Pieces:
    """A model's normal pieces, as the strings they stand for, and the ids of its 256 byte pieces."""

    rows: list[tuple[str, int, float]]
    byte_ids: list[int]
    surfaces: list[bytes]

    @property
    def cut(self) -> Cut:
        """How units are cut: into runs of letters and of others if no piece crosses between them. A piece that holds a space after another character, or a line end beside one, isn't supported."""
        bare = [s.lstrip(" ") for s, *_ in self.rows]
        if any(" " in x or ("\n" in x and len(s) > 1) for x, (s, *_) in zip(bare, self.rows, strict=True)):
            raise ValueError("a piece crosses from one word to the next")
        return _WORDS if any(map(_CROSSED.search, bare)) else _RUNS

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows, byte_ids, surfaces = [], [0] * 256, []
        for k in range(model.get_piece_size()):
            piece, surface = model.id_to_piece(k), b""
            if model.is_byte(k):
                byte_ids[int(piece[3:5], 16)] = k
                surface = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                rows.append((piece.replace(_SPACE, " "), k, model.get_score(k)))
                surface = rows[-1][0].encode()
            surfaces.append(surface)
        return cls(rows, byte_ids, surfaces)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "surface string, id int, score double")


def _idle() -> None:
    """At a task's end: its worker stays, and what it doesn't use goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _tasks(df: DataFrame) -> int:
    """Tasks for units, whose lattices are much larger than they are: not to be joined for their small size, and more than the texts themselves would need, as what a task sorts and folds stays in memory."""
    return SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lattice(found: DataFrame, pieces: Pieces, held: Column | None = None) -> DataFrame:
    """name, ids (array of int), who for the distinct names of found (name, long): the unit is long, or the name itself if that is null. who: what held, an aggregate, gathers for each name, or for each (name, part) where found has part."""
    by = ["name", *(["part"] if "part" in found.columns else [])]
    longest = max((len(s) for s, *_ in pieces.rows), default=1)
    table = F.broadcast(pieces.table(found.sparkSession))  # a model's pieces: tens of thousands of rows
    # Substrings are taken from windows, and rows carry the name only, so that a long unit costs in proportion to its
    # length; its first substring carries who.
    unit = found.groupBy(*by).agg(F.coalesce(F.max("long"), "name").alias("unit"), (F.lit(None).cast("string") if held is None else held).alias("who"))
    windows = unit.withColumn("w", F.explode(F.expr(f"sequence(0, char_length(unit) - 1, {SHORT})"))).select(*by, "w", F.expr(f"substr(unit, w + 1, {SHORT + longest})").alias("x"), F.expr("IF(w = 0, who, NULL)").alias("who"))
    # Places between a window's first SHORT and its end belong to the next one, which begins there.
    starts = windows.withColumn("s", F.explode(F.expr(f"sequence(0, least({SHORT}, char_length(x)) - 1)"))).withColumn("who", F.expr("IF(s = 0, who, NULL)"))
    substrings = starts.withColumn("n", F.explode(F.expr(f"sequence(1, least({longest}, char_length(x) - s))"))).select(*by, (F.col("w") + F.col("s")).alias("s"), "n", F.expr("substr(x, s + 1, n)").alias("surface"), F.expr("IF(n = 1, who, NULL)").alias("who"))
    edge = F.struct((F.col("s") + F.col("n")).alias("e"), "s", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(NO_PIECE)).alias("score"), F.when(F.col("id").isNull(), F.col("surface")).alias("b"))
    edges = substrings.join(table, "surface", "left").where("id IS NOT NULL OR n = 1").select(*by, edge.alias("edge"), "who")
    grouped = edges.groupBy(*by).agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.first("who", ignorenulls=True).alias("who"))
    # done[k]: the last piece of the best path to place k; the other fields are of place e, whose edges come next to one
    # another. Edges come by their end, so what they start from is done.
    last = "struct<score: double, s: int, id: int, b: string>"
    put = "array_append(a.done, named_struct('score', a.score, 's', a.s, 'id', a.id, 'b', a.b))"
    step = "IF(x.s = a.e, a.score, a.done[x.s].score) + x.score"
    best = f"""aggregate(edges, named_struct('done', cast(array() AS array<{last}>), 'e', 0, 'score', 0D, 's', 0, 'id', -2, 'b', cast(NULL AS string)),
        (a, x) -> IF(x.e > a.e, named_struct('done', {put}, 'e', x.e, 'score', {step}, 's', x.s, 'id', x.id, 'b', x.b),
            IF({step} > a.score, named_struct('done', a.done, 'e', a.e, 'score', {step}, 's', x.s, 'id', x.id, 'b', x.b), a)),
        a -> {put})"""
    path = f"""aggregate(sequence(size(best) - 1, 1, -1), named_struct('at', size(best) - 1, 'out', cast(array() AS array<{last}>)),
        (a, k) -> IF(a.at = k, named_struct('at', best[k].s, 'out', array_append(a.out, best[k])), a), a -> reverse(a.out))"""
    held = ",".join(map(str, pieces.byte_ids))
    ids = f"""flatten(transform(path, p -> IF(p.id >= 0, array(p.id),
        transform(sequence(1, octet_length(p.b)), j -> element_at(array({held}), cast(conv(substr(hex(p.b), 2 * j - 1, 2), 16, 10) AS int) + 1)))))"""
    return grouped.withColumn("best", F.expr(best)).withColumn("path", F.expr(path)).select("name", F.expr(ids).alias("ids"), "who")


def frequent(docs: DataFrame, head: int, cut: Cut = _RUNS) -> DataFrame:
    """unit: some head or fewer of the most frequent short ones of a sample of documents, by the tasks' counts. Which ones they are changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"unit": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

        def top(k: int) -> pa.Table:
            return held if len(held) <= k else held.take(pc.select_k_unstable(held, k, [("n", "descending")]))

        for batch in batches:
            for part in blocks(batch, 0, CUT_BYTES):
                counts = pc.value_counts(_cut(part.column(0), cut).flatten())
                more = pa.table({"unit": counts.field(0), "n": counts.field(1)})
                length = pc.utf8_length(more["unit"])
                held = pa.concat_tables([held, more.filter(pc.and_(pc.greater(length, 0), pc.less_equal(length, SHORT)))]).group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"])
                held = top(TASK_HEAD) if len(held) > TASK_UNITS else held
        yield from top(TASK_HEAD).to_batches()
        _idle()

    docs = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    counted = written(docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")))
    # The least count of which there are at most head units: from the numbers of units by count, in powers of 1.1.
    step = F.floor(F.log(1.1, "n")).cast("int")
    by_step = sorted(((r.k, r["count"]) for r in counted.groupBy(step.alias("k")).count().collect()), reverse=True)
    least, held = None, 0
    for k, n in by_step:
        held += n
        if held > head:
            break
        least = k
    return counted.where(step >= least).select("unit") if least is not None else counted.where("false").select("unit")


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names.to_pylist()), np.uint64, len(names))


def _places(flat: pa.Array, names: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """Where in names, which come by their hashes, flat's strings are; -1 where they aren't. Looking up costs what a block's distinct strings do, not what names do."""
    coded = flat.dictionary_encode()
    at = np.minimum(np.searchsorted(hashes, _hashes(coded.dictionary)), len(hashes) - 1)
    same = pc.equal(names.take(pa.array(at)), coded.dictionary).to_numpy(zero_copy_only=False)
    return np.where(same, at, -1)[coded.indices.to_numpy()]


class _Split:
    """A block of texts in units: which are known (their places), and numbers for the others, by their first place in each text."""

    def __init__(self, texts: pa.Array, cut: Cut, known: pa.Array, hashes: np.ndarray):
        lists = _cut(texts, cut)
        flat = lists.flatten()
        self.ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        at = _places(flat, known, hashes)
        self.unknown = at < 0
        self.places = np.maximum(at, 0)
        coded = flat.filter(pa.array(self.unknown)).dictionary_encode()
        row = np.searchsorted(self.ends, np.flatnonzero(self.unknown), side="right")
        both = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy().astype(np.int64)
        _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
        order = np.argsort(first)
        #: For each unit of a text that isn't known: its text's row and its number there, from 0.
        self.rows = row[first[order]]
        self.counts = np.bincount(self.rows, minlength=len(lists))
        base = np.concatenate(([0], np.cumsum(self.counts)))
        self.numbers = np.arange(len(order)) - base[self.rows]
        self.units = coded.dictionary.take(coded.indices.take(pa.array(first[order])))
        #: For each place that isn't known, which of them it is.
        self.which = np.argsort(order)[inverse]


def encoded(docs: DataFrame, pieces: Pieces, head: int = HEAD, decode: bool = False) -> DataFrame:
    """docs' doc_id and text, with ids (array of int) and n_tokens; with decode, also what the ids decode to, as decoded().

    A null or empty text has no pieces. Every row, repeated ones too, is encoded; a null id stays null. Decoded ids are
    the text, whatever its characters. An empty table gives none. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    cut = pieces.cut
    top = lattice(frequent(docs, head, cut).select(F.col("unit").alias("name"), F.lit(None).cast("string").alias("long")).repartition(_tasks(docs), "name"), pieces).toArrow().combine_chunks()
    # The empty string, which stands for nothing, is known as well.
    names = pa.concat_arrays([pa.array([""]), *top.column("name").cast(pa.string()).chunks])
    found = pa.concat_arrays([pa.array([[]], pa.list_(pa.int32())), *(_plain(x) for x in top.column("ids").chunks)])
    # By hash; of names that share one the first is known, the others go the way of rare units.
    hashes, first = np.unique(_hashes(names), return_index=True)
    known = spark.sparkContext.broadcast((names.take(pa.array(first)), hashes, found.take(pa.array(first)), pa.array(pieces.surfaces, pa.binary()) if decode else None))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0, CUT_BYTES):
                own = _Split(part.column(0), cut, *known.value[:2])
                name, long = own.units, pa.nulls(len(own.units), pa.string())
                over = pc.greater(pc.utf8_length(name), SHORT)
                if pc.any(over).as_py():
                    long = pc.if_else(over, name, None)
                    # Long ones may be frequent: each goes to SALTS tasks, by its texts.
                    salts = (part.column(1).take(pa.array(own.rows)).to_numpy() % SALTS).tolist()
                    digests = [None if x is None else f"\n{hashlib.blake2b(x.encode(), digest_size=16).hexdigest()}{k}" for x, k in zip(long.to_pylist(), salts, strict=True)]
                    name = pc.coalesce(pa.array(digests, pa.string()), name)
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(own.rows)), pa.array(own.numbers, pa.int32()), name, long], names=["key", "k", "name", "long"])
        _idle()

    # One exchange by name brings a unit's texts together; it is rare, as the head has the frequent ones. Those of many
    # texts go on in parts of bounded size.
    rest = docs.select("text", "key").mapInArrow(others, "key long, k int, name string, long string").repartition(_tasks(docs), "name")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("key", "k"))
    rest = rest.withColumn("part", F.floor((nth - 1) / WHO).cast("int"))
    paths = lattice(rest, pieces, F.collect_list(F.struct("key", "k")))
    # An answer is the unit's number in three bytes, and its ids.
    width = 2 if len(pieces.surfaces) <= 1 << 16 else 3
    hexed = F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2 * width, "0")), "")
    each = paths.select(hexed.alias("hexed"), F.explode("who").alias("x"))
    told = each.groupBy("x.key").agg(F.collect_set(F.unhex(F.concat(F.lpad(F.hex("x.k"), 6, "0"), "hexed"))).alias("rest"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            for part in blocks(batch, 1, CUT_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([None if t is None else squeeze(t.encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "key", "packed"])
        _idle()

    # Texts travel compressed.
    held = docs.mapInArrow(packed, "doc_id long, key long, packed binary").join(told, "key", "left").select("doc_id", "packed", "rest")
    columns = ["doc_id", "text", "ids", "n_tokens", *(["decoded"] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        units_known, hashes, ids_known, surfaces = known.value
        for batch in batches:
            for part in blocks(batch, 1, CUT_BYTES):
                texts = pa.array([None if x is None else open_(x).decode() for x in part.column(1).to_pylist()], pa.string())
                own = _Split(texts, cut, units_known, hashes)
                counts = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy()
                if (counts != own.counts).any():
                    raise ValueError("a text lacks the paths of some of its units")
                k, ids = _answers(part.column(2).flatten(), width)
                order = np.lexsort((k, np.repeat(np.arange(len(counts)), counts)))
                table = pa.concat_arrays([ids_known, ids.take(pa.array(order))])
                places = own.places.astype(np.int64)
                places[own.unknown] = len(ids_known) + own.which
                sizes = table.value_lengths().to_numpy()[places]
                ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[np.concatenate(([0], own.ends))]
                flat = table.take(pa.array(places)).flatten()
                out = [part.column(0), texts, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(np.diff(ends))]
                yield pa.RecordBatch.from_arrays([*out, *([_joined(flat, ends, surfaces)] if decode else [])], names=columns)
        _idle()

    return held.mapInArrow(run, "doc_id long, text string, ids array<int>, n_tokens long" + ", decoded string" * decode)


def _answers(flat: pa.Array, width: int) -> tuple[np.ndarray, pa.ListArray]:
    """The units' numbers and ids of answers: three bytes, then width bytes an id."""
    sizes = pc.binary_length(flat).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(flat.to_pylist()), np.uint8).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    own = np.ones(len(data), bool)
    for k in range(3):
        own[starts + k] = False
    ids = np.zeros(int(own.sum()) // width, np.int32)
    for byte in data[own].reshape(-1, width).T:
        ids = ids << 8 | byte
    ends = np.concatenate(([0], np.cumsum((sizes - 3) // width)))
    return data[starts] << 16 | data[starts + 1] << 8 | data[starts + 2], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def _plain(lists: pa.Array) -> pa.ListArray:
    """Lists of 32-bit ids whose elements and offsets are of plain kinds."""
    sizes = lists.value_lengths().to_numpy()
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), lists.flatten().cast(pa.int32()))


def _joined(flat: pa.Array, ends: np.ndarray, surfaces: pa.Array) -> pa.Array:
    """What ids decode to, text by text: their surfaces, joined, without the space put before."""
    strings = surfaces.take(flat)
    places = np.concatenate(([0], np.cumsum(pc.binary_length(strings).to_numpy(), dtype=np.int64)))[ends]
    whole = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(places.astype(np.int32)), strings.buffers()[2]])
    return pc.utf8_slice_codeunits(whole, 1)


def _text(ids: Iterable[int], surfaces: list[bytes]) -> str:
    return b"".join([surfaces[i] for i in ids])[1:].decode(errors="replace")


def decoded(df: DataFrame, pieces: Pieces) -> DataFrame:
    """df with decoded: the text of each row's ids, which begins after the space put before it. Ids beyond the table are an error."""
    held = df.sparkSession.sparkContext.broadcast(pieces.surfaces)
    names, at = [*df.columns, "decoded"], df.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                table = held.value
                texts = [_text(ids or (), table) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "decoded string"]))
