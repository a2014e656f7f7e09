"""Projections, filters and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that an "in" filter may list.
MAX_IN = 50


def filter_typed(df: DataFrame, column: str, op: str, value: Any) -> DataFrame:
    """Rows for which `column op value`, with op one of eq, ne, lt, lte, gt, gte, in. Unknown columns and operators are errors."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    c = F.col(column)
    if op == "in":
        values = list(value)
        if len(values) > MAX_IN:
            raise ValueError(f"more than {MAX_IN} values")
        return df.where(c.isin(values))
    tests = {"eq": c == value, "ne": c != value, "lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}
    if op not in tests:
        raise ValueError(f"no operator {op}")
    return df.where(tests[op])


def event_slot_filter(events: DataFrame, slots: Mapping[str, Any]) -> DataFrame:
    """Events whose columns have the slots' values; a slot of None filters nothing."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in slots.items() if v is not None], events)


def exclude_null_safe(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows whose column is not value; nulls stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Each measure column as a row (period_kind, amount_kind, amount), from one scan; nulls give no row."""
    args = ", ".join(f"'{p}', '{a}', `{c}`" for c, (p, a) in measures.items())
    return df.selectExpr(*[f"`{c}`" for c in ids], f"stack({len(measures)}, {args}) AS (period_kind, amount_kind, amount)").where("amount IS NOT NULL")


def unpivot_all_columns(df: DataFrame, ids: Sequence[str], variable: str = "ticker", value: str = "value") -> DataFrame:
    """All columns besides ids as rows."""
    return df.unpivot(list(ids), None, variable, value).where(F.col(value).isNotNull())


def unpivot_actor_columns(wide: DataFrame, long: DataFrame, ids: Sequence[str], actors: Sequence[str], value: str = "flow") -> DataFrame:
    """Wide actor columns as rows, with the long history; of several values for one key and actor, the largest."""
    rows = wide.unpivot(list(ids), list(actors), "actor", value)
    return rows.unionByName(long.select(*ids, "actor", value)).groupBy(*ids, "actor").agg(F.max(value).alias(value)).where(F.col(value).isNotNull())


def pivot_items(df: DataFrame, key: Sequence[str], items: Sequence[str], item: str = "item_code", value: str = "value", derived: Mapping[str, Column] | None = None) -> DataFrame:
    """The chosen items as columns (the largest value of each), then derived columns."""
    out = df.where(F.col(item).isin(list(items))).groupBy(*key).pivot(item, list(items)).agg(F.max(value))
    return out.withColumns(dict(derived or {}))


def assemble_wide(pieces: Mapping[str, DataFrame], key: Sequence[str], value: str = "value") -> DataFrame:
    """One column for each piece (key, value), rows for the keys of any: one union and one pivot, no chain of joins."""
    rows = [df.select(*key, F.lit(name).alias("_item"), value) for name, df in pieces.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(*key).pivot("_item", list(pieces)).agg(F.max(value))


def normalize_numeric(df: DataFrame, columns: Sequence[str], kind: str = "double", whole: Sequence[str] = ()) -> DataFrame:
    """Texts with separators as numbers; what is no finite number is null, and so is a fraction in a `whole` column. bad: the columns whose text was refused."""
    bad = []
    for c in columns:
        text = F.regexp_replace(F.trim(F.col(c).cast("string")), ",", "")
        number = text.try_cast("double")
        ok = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
        if c in whole:
            ok = ok & (number == F.floor(number))
        bad.append(F.when(F.col(c).isNotNull() & (text != "") & ~F.coalesce(ok, F.lit(False)), F.lit(c)))
        df = df.withColumn(f"_n_{c}", F.when(ok, text.try_cast(kind) if c not in whole else number.cast("bigint")))
    df = df.withColumn("bad", F.array_compact(F.array(*bad)))
    for c in columns:
        df = df.withColumn(c, F.col(f"_n_{c}")).drop(f"_n_{c}")
    return df


def scale_units(df: DataFrame, columns: Sequence[str], factor: int) -> DataFrame:
    """Columns times a factor, as exact decimals."""
    return df.withColumns({c: (F.col(c).cast("decimal(30,4)") * F.lit(factor)).cast("decimal(38,4)") for c in columns})


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass(frozen=True)
class ObjectSet:
    """A lazily composed selection: a kind of object, filters, followed relations; with the steps that led to it.

    nodes: kind -> (frame, id column, known-at column or None); edges: relation -> (frame, from kind, from column, to kind,
    to column, known-at column or None). Nodes and edges are cut at as_of.
    """

    nodes: Mapping[str, tuple[DataFrame, str, str | None]]
    edges: Mapping[str, tuple[DataFrame, str, str, str, str, str | None]]
    as_of: Any
    kind: str = ""
    frame: DataFrame | None = None
    lineage: tuple[str, ...] = field(default_factory=tuple)

    def _known(self, df: DataFrame, known: str | None) -> DataFrame:
        return df if known is None else df.where(F.col(known) <= F.lit(self.as_of))

    def of(self, kind: str) -> ObjectSet:
        df, _, known = self.nodes[kind]
        return replace(self, kind=kind, frame=self._known(df, known), lineage=(f"kind:{kind}",))

    def where(self, column: str, op: str, value: Any) -> ObjectSet:
        return replace(self, frame=filter_typed(self.frame, column, op, value), lineage=(*self.lineage, f"filter:{column} {op} {value}"))

    def follow(self, relation: str) -> ObjectSet:
        df, kind, src, to, dst, known = self.edges[relation]
        if kind != self.kind:
            raise ValueError(f"{relation} starts at {kind}")
        edge = self._known(df, known).select(F.col(src).alias("_src"), F.col(dst).alias("_dst"))
        ids = edge.join(self.frame.select(F.col(self.nodes[kind][1]).alias("_src")), "_src", "left_semi").select("_dst").distinct()
        target, key, at = self.nodes[to]
        return replace(self, kind=to, frame=self._known(target, at).join(ids, F.col(key) == F.col("_dst"), "left_semi"), lineage=(*self.lineage, f"follow:{relation}"))

    def affordances(self) -> dict[str, list[str]]:
        """Fields that can be filtered and relations that can be followed from here."""
        return {"fields": self.frame.columns, "relations": [r for r, e in self.edges.items() if e[1] == self.kind]}


def column_catalog_probe(dictionary: DataFrame, items: DataFrame, day: Any, query: str, item: str = "item_code", name: str = "item_name", date_col: str = "trade_date") -> DataFrame:
    """Dictionary entries whose name holds the query, with whether the item has values on the last day up to day."""
    last = items.where(F.col(date_col) <= F.lit(day)).groupBy(item).agg(F.max(date_col).alias("_last"))
    newest = last.agg(F.max("_last").alias("_newest"))
    alive = last.join(F.broadcast(newest)).where("_last = _newest").select(item, F.lit(True).alias("alive"))
    return dictionary.where(F.contains(F.lower(name), F.lit(query.lower()))).join(alive, item, "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
