"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

Every feature of a text is binned. Training goes round the features, again and again; each visit fits a shallow tree
(at most LEAVES leaves over the bins) to the gradient and adds a small step of it to the feature's lookup table. The
pairs whose joint bins reduce the loss most then get tables of their own, by the same cycles. A score is the logistic
function of the tables' sum, so scoring is a lookup per feature and pair, vectorised over rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: Labelled rows on which a model is fitted, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3

BINS, PAIR_BINS, LEAVES = 32, 8, 4
CYCLES, PAIR_CYCLES, PAIRS, RATE = 120, 60, 8, 0.15

FEATURES = (
    "log_words",
    "mean_word",
    "distinct_words",
    "top_word",
    "same_as_last",
    "distinct_lines",
    "words_per_line",
    "upper",
    "digits",
    "symbols",
    "exclaims",
    "bars",
    "stops",
    "capitalised",
    "marked_words",
    "sentence_words",
)

_SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]\\^~=@_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")
_MARKED = re.compile(r"[#$%&*|!~^]{2,}")


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES; a null or empty text has those of no words, lines and characters."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    low = text.count(" the ") + text.count(" of ") + text.count(" la ") + text.count(" de ") + text.count(" der ") + text.count(" die ")
    stops = text.count(".")
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        n / len(lines),
        len(_UPPER.findall(text)) / chars,
        len(_DIGITS.findall(text)) / chars,
        len(_SYMBOLS.findall(text)) / chars,
        text.count("!") / n,
        text.count("|") / n,
        low / n,
        sum(map(str.istitle, words)) / n,
        len(_MARKED.findall(text)) / n,
        n / (stops + 1),
    ]


@dataclass
class Model:
    """cuts: bounds of each feature's bins; tables: its lookup table. pairs: (i, j, table over both features' coarse bins)."""

    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=lambda: [np.empty(0)] * len(FEATURES))
    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1)] * len(FEATURES))
    coarse: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1, np.int64)] * len(FEATURES))
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        total = np.full(len(x), self.bias)
        for k, t in enumerate(self.tables):
            total += t[bins[:, k]]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float = 5.0) -> np.ndarray:
    """Steps per bin: the bins cut greedily into runs with the least loss, each with its Newton step."""
    gs, hs = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + smooth)
    runs = [(0, len(g))]
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for r, (a, b) in enumerate(runs):
            if b - a > 1:
                at = np.arange(a + 1, b)
                won = gain(a, at) + gain(at, b) - gain(a, b)
                if won.max() > best[0]:
                    best = (won.max(), r, at[won.argmax()])
        if best[1] is None:
            break
        a, b = runs[best[1]]
        runs[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + smooth)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of features x and labels y (0 or 1). Without rows, or with one label only, scores are its smoothed share."""
    model = Model()
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model.bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    model.coarse = [np.arange(s) * min(PAIR_BINS, s) // s for s in sizes]
    bins = model.binned(x)
    total = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for k, s in enumerate(sizes):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, k], g, s), np.bincount(bins[:, k], h, s), LEAVES)
            model.tables[k] += step
            total += step[bins[:, k]]
    low = [model.coarse[k][bins[:, k]] for k in range(len(sizes))]
    wide = [int(c.max()) + 1 for c in model.coarse]
    g, h = slopes()
    gains = []
    for i, j in combinations(range(len(sizes)), 2):
        cell = low[i] * wide[j] + low[j]
        gains.append((float((np.bincount(cell, g) ** 2 / (np.bincount(cell, h) + 5.0)).sum()), i, j))
    chosen = [(i, j, np.zeros((wide[i], wide[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_CYCLES):
        for i, j, t in chosen:
            g, h = slopes()
            cell = low[i] * wide[j] + low[j]
            gc, hc = (np.bincount(cell, v, t.size).reshape(t.shape) for v in (g, h))
            # A shallow tree over two features: rows in two runs, columns cut within each.
            split = _tree(gc.sum(1), hc.sum(1), 2)
            step = np.zeros(t.shape)
            for v in np.unique(split):
                rows = split == v
                step[rows] = RATE * _tree(gc[rows].sum(0), hc[rows].sum(0), 2)
            t += step
            total += step[low[i], low[j]]
    model.pairs = chosen
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, folds: int = 5) -> Model:
    """Fits on at most limit labelled rows whose crc32(doc_id as text) mod folds isn't 0. An id that is labelled twice counts once, as 0 if any label is 0."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # limit rows of two numbers: small enough to broadcast, whatever the corpus.
    found = with_features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # Of rows that share an id one counts, so that no more than limit rows come to the driver.
    rows = found.groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("x")).select("doc_id", "x.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([r.features for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.quality for r in rows], dtype=float))


def _mapped(df: DataFrame, name: str, kind: str, arrow: pa.DataType, f) -> DataFrame:
    """df with a column name of f(texts) per block of rows."""
    df = df.drop(name)
    at, names = df.columns.index("text"), [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(f(part.column(at).to_pylist()), arrow)], names=names)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` {kind}"])
    return df.mapInArrow(run, schema)


def with_features(df: DataFrame) -> DataFrame:
    return _mapped(df, "features", "array<double>", pa.list_(pa.float64()), lambda texts: [features(t) for t in texts])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, higher: quality likelier). Null and empty texts are scored as texts without words; each row by itself. A column score of docs is replaced, others pass through."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> np.ndarray:
        return held.value.score(np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES)))

    return _mapped(docs, "score", "double", pa.float64(), run)
