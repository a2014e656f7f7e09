"""Fill-in-the-middle texts: documents cut between lines into prefix, middle and suffix, by counts of memoised chunks.

A rolling hash over the last WINDOW bytes cuts a text into chunks, so the same passage gives the same chunks wherever it
stands. A chunk's summary (its lines and code points, and whether a marker lies in it) is worked out once and kept in a
memo of bounded size; a chunk is known only if its whole content is equal to the one in the memo, not its hash alone.
Markers that lie across a boundary are seen in the last and first two bytes of neighbours. Summed up along a text, the
counts say in which chunk a cut falls and how many line ends are before it there; only that chunk is looked into.
Nothing is shuffled: cuts, the text's new form and the way back are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents transformed, and those of them that put the suffix first, of a hundred; the draws' seed.
RATE, SPM, SEED = 100, 50, 7
#: The hash covers WINDOW bytes (a power of two); chunks have about 2**BITS bytes, LEAST and MOST at least and at most.
WINDOW, BITS, LEAST, MOST = 32, 9, 64, 8192
#: Content that a task's memo holds, at most twice.
MEMO_BYTES = 16 << 20

_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def rolling(data: np.ndarray) -> np.ndarray:
    """At each place a hash of the WINDOW bytes that end there (of places before the first as of zeros)."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    factor, span = 0x85EBCA6B, 1
    while span < WINDOW:
        h[span:] += h[:-span] * np.uint32(factor)  # numpy reads the right side as a whole first
        factor, span = factor * factor & 0xFFFFFFFF, 2 * span
    return h ^ (h >> np.uint32(15))


def cuts(data: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """For each text of data, which starts holds the first places and the end of, the places where its chunks end: never inside a code point."""
    whole = np.append((data[1:] & 0xC0) != 0x80, True)
    candidates = np.flatnonzero((rolling(data) >> np.uint32(32 - BITS) == 0) & whole) + 1 if len(data) else np.empty(0, np.int64)
    out = []
    for a, b, low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), *np.searchsorted(candidates, [starts[:-1], starts[1:]]).tolist(), strict=True):
        ends, last = [], a
        for c in [*candidates[low:high].tolist(), b]:
            while c - last > MOST:
                last += MOST
                while not whole[last - 1]:
                    last -= 1
                ends.append(last)
            if c > last and (c == b or c - last >= LEAST):
                ends.append(c)
                last = c
        out.append(ends)
    return out


class Memo:
    """Summaries of chunks by content: line ends, code points, whether a marker is inside. Of bounded size: the older half goes."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.held, self.new, self.old = most, 0, {}, {}

    def of(self, chunk: bytes) -> tuple[int, int, bool]:
        known = self.new.get(chunk)
        if known is None:
            known = self.old.get(chunk) or (chunk.count(b"\n"), len(chunk.decode()), any(m in chunk for m in _MARKS))
            if self.held + len(chunk) > self.most:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[chunk] = known
            self.held += len(chunk)
        return known


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) with ends, lines, chars: bytes, line ends and code points up to the end of each chunk, and marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            for part in blocks(batch, 1):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                joined = b"".join(texts)
                starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
                ends, lines, chars, marked, sizes = [], [], [], [], []
                for first, own in zip(starts.tolist(), cuts(np.frombuffer(joined, np.uint8), starts), strict=False):
                    last, line, char, found = first, 0, 0, False
                    for end in own:
                        n, c, inside = memo.of(joined[last:end])
                        found = found or inside or last > first and any(m in joined[last - 2 : min(last + 2, own[-1])] for m in _MARKS)
                        last, line, char = end, line + n, char + c
                        ends.append(end - first)
                        lines.append(line)
                        chars.append(char)
                    marked.append(found)
                    sizes.append(len(own))
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ends, lines, chars)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.compute.fill_null(part.column(1), ""), *lists, pa.array(marked, pa.bool_())], names=["doc_id", "text", "ends", "lines", "chars", "marked"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, ends array<int>, lines array<int>, chars array<int>, marked boolean")


def _draw(group: int) -> Column:
    """The group-th 8 hex digits, from 1, of the sha256 of seed and id, as a number."""
    return F.conv(F.substring("_drawn", 8 * group - 7, 8), 16, 10).cast("long")


def _located(df: DataFrame, k: str, name: str) -> DataFrame:
    """df with name: the bytes and code points of the first k lines. The chunk where they end is the first with k line ends up to its own end."""
    df = df.withColumn("_c", F.expr(f"size(filter(lines, x -> x < {k}))"))
    before = [f"IF(_c > 0, element_at({c}, greatest(_c, 1)), 0)" for c in ("ends", "lines", "chars")]
    df = df.withColumn("_b", F.expr(f"named_struct('bytes', {before[0]}, 'lines', {before[1]}, 'chars', {before[2]})"))
    df = df.withColumn("_head", F.expr(f"substring_index(cast(substring(cast(text AS binary), _b.bytes + 1, coalesce(try_element_at(ends, _c + 1), _b.bytes) - _b.bytes) AS string), '\\n', cast({k} - _b.lines AS int))"))
    none, all_ = "named_struct('bytes', 0, 'chars', 0)", "named_struct('bytes', octet_length(text), 'chars', char_length(text))"
    found = "named_struct('bytes', _b.bytes + octet_length(_head) + 1, 'chars', _b.chars + char_length(_head) + 1)"
    return df.withColumn(name, F.expr(f"IF({k} = 0, {none}, IF({k} = n, {all_}, {found}))")).drop("_c", "_b", "_head")


def transformed(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, text, n (its lines), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output of each row of docs.

    Cuts, and whether and how a text changes form, follow from the seed and doc_id. A null text is empty; an empty one, and
    one that holds a marker, stays plain. A null id draws as an empty string would. Rows that share an id are cut at the
    same draws, each by its own lines. A text of any length is cut whole. An empty table gives none. Other columns of docs
    are ignored.
    """
    df = chunked(docs).withColumn("_drawn", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    df = df.withColumn("n", F.expr("cast(coalesce(try_element_at(lines, -1), 0) + IF(text = '' OR endswith(text, '\\n'), 0, 1) AS bigint)"))
    plain = (F.col("text") == "") | F.col("marked") | (_draw(3) % 100 >= rate)
    df = df.withColumn("form", F.when(plain, "plain").when(_draw(4) % 100 < spm, "spm").otherwise("psm"))
    one, two = _draw(1) % (F.col("n") + 1), _draw(2) % (F.col("n") + 1)
    # A plain text has no cuts: both at 0.
    df = df.withColumn("_one", F.when(plain, 0).otherwise(F.least(one, two))).withColumn("_two", F.when(plain, 0).otherwise(F.greatest(one, two)))
    df = _located(_located(df, "_one", "_p"), "_two", "_m")
    piece = "cast(substring(cast(text AS binary), {} + 1, {}) AS string)"
    p, m, s = (F.expr(piece.format(a, b)) for a, b in (("0", "_p.bytes"), ("_p.bytes", "_m.bytes - _p.bytes"), ("_m.bytes", "octet_length(text) - _m.bytes")))
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    spm_ = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    out = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    cut = F.col("form") != "plain"
    counts = [F.when(cut, x.cast("long")).alias(name) for x, name in ((F.col("_p.chars"), "prefix_chars"), (F.col("_m.chars") - F.col("_p.chars"), "middle_chars"))]
    return df.select("doc_id", "text", "n", "form", *counts, out.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output in a form was made of. Its markers are the only ones there, as texts that hold any stay plain."""
    x = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1]))
