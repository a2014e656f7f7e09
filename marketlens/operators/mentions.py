"""Names of a dictionary found inside texts, as substrings."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that one automaton holds, at most; it is built once in each Python worker.
MAX_NAMES = 500_000
#: The automaton of the last dictionary that this worker used, by its key.
_BUILT: dict[str, object] = {}


def _automaton(key: str, names: list[str]):
    if key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        built = ahocorasick.Automaton()
        for name in names:
            built.add_word(name, name)
        built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def normalized(texts: pa.Array) -> pa.Array:
    """Unicode NFKC, with white space collapsed."""
    return pa.array([None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()) for x in texts.to_pylist()], pa.string())


def _normal(df: DataFrame, column: str) -> DataFrame:
    """df's key column and column as normalized(), both under their names."""
    names = df.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([normalized(c) if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return df.mapInArrow(run, df.schema)


def dictionary(names: DataFrame, name: str = "name", entity: str = "entity_id", min_len: int = 3) -> DataFrame:
    """name (normalised) and entity of the names that stand for one entity only and have min_len characters or more."""
    clean = _normal(names.select(F.col(entity).alias("entity"), F.col(name).alias("name")).where("entity IS NOT NULL AND name IS NOT NULL"), "name")
    known = clean.where(F.char_length("name") >= min_len).groupBy("name").agg(F.min("entity").alias("entity"), F.max("entity").alias("_other"))
    return known.where("entity = _other").drop("_other")


def dictionary_mentions(texts: DataFrame, names: DataFrame, doc: str = "doc_id", text: str = "text", name: str = "name", entity: str = "entity_id", min_len: int = 3, max_names: int = MAX_NAMES) -> DataFrame:
    """doc and entity for each name of the dictionary that a text holds, as a substring, both in Unicode NFKC with white space collapsed.

    Case counts. Names of several entities are left out, and those shorter than min_len. A dictionary of at most max_names
    becomes an Aho-Corasick automaton, with which each text is read once, however many names there are. A larger one is
    joined: texts' distinct leading pieces with those of names, and what meets is looked up in the text. Null texts hold
    no name.
    """
    known = dictionary(names, name, entity, min_len)
    own = texts.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    held = [r.name for r in known.select("name").limit(max_names + 1).collect()]
    found = _read(own, held) if len(held) <= max_names else _met(_normal(own, "_text"), known)
    pairs = found.join(F.broadcast(known) if len(held) <= max_names else known, "name")
    return pairs.select(F.col("_doc").alias(doc), F.col("entity").alias(entity)).distinct()


def _read(own: DataFrame, names: list[str]) -> DataFrame:
    """_doc, name: what an automaton of the names finds in each text."""
    held, key = own.sparkSession.sparkContext.broadcast(sorted(names)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not held.value:
                return
            built = _automaton(key, held.value)
            rows, hits = [], []
            for k, x in enumerate(normalized(batch.column(1)).to_pylist()):
                one = {name for _, name in built.iter(x)}
                rows += [k] * len(one)
                hits += one
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=["_doc", "name"])

    return own.mapInArrow(run, f"_doc {own.schema['_doc'].dataType.simpleString()}, name string")


def _met(own: DataFrame, known: DataFrame) -> DataFrame:
    """_doc, name by joins, for a dictionary without bound: no text meets a name but by its leading characters."""
    size = known.agg(F.min(F.char_length("name"))).first()[0]
    texts = own.withColumn("_h", F.xxhash64("_text"))  # equal texts are one; two that share a hash are told apart below
    names = ["_h", "lead"]

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, x in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                pieces = list({x[k : k + size] for k in range(len(x) - size + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()] * len(pieces), pa.int64()), pa.array(pieces, pa.string())], names=names)

    pieces = texts.select("_h", "_text").dropDuplicates(["_h", "_text"]).mapInArrow(leads, "_h long, lead string")
    met = pieces.join(known.select("name", F.expr(f"substr(name, 1, {size})").alias("lead")), "lead").select("_h", "name").distinct()
    return texts.join(met, "_h").where(F.contains("_text", "name")).select("_doc", "name")
