"""Time-varying slopes: Kalman filters over sorted paths of any length.

A path is cut into ranges of its rows. What a range does to a slope's distribution is one small element, and elements of
ranges that follow each other combine, so each range learns its start without the rows before it, and all are filtered
at once. No key's rows meet in one task because of its size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.sources.sink import written

Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _step(y: float, x: np.ndarray, q: float, h: float) -> Element:
    """One row: given the slopes before, those after are N(A slopes + b, C), and the row's likelihood is exp(eta slopes - slopes J slopes / 2)."""
    s = q * float(x @ x) + h
    gain = q * x / s
    a = np.eye(len(x)) - np.outer(gain, x)
    return a, gain * y, q * a, x * y / s, np.outer(x, x) / s


def _then(one: Element, two: Element) -> Element:
    """The element of one's rows followed by two's."""
    a, b, c, eta, j = one
    a2, b2, c2, eta2, j2 = two
    eye = np.eye(len(b))
    ahead, back = a2 @ np.linalg.inv(eye + c @ j2), a.T @ np.linalg.inv(eye + j2 @ c)
    return ahead @ a, ahead @ (b + c @ eta2) + b2, ahead @ c @ a2.T + c2, back @ (eta2 - j2 @ b) + eta, back @ j2 @ a + j


def _after(mean: np.ndarray, var: np.ndarray, e: Element) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, eta, j = e
    ahead = a @ np.linalg.inv(np.eye(len(b)) + var @ j)
    return ahead @ (mean + var @ eta) + b, ahead @ var @ a.T + c


def slope_paths(rows: DataFrame, factors: Sequence[str], key: Sequence[str], order: str, y: str = "y") -> DataFrame:
    """rows with nth (from 1), and beta_<f> and var_<f> of each factor f: the slopes of y on the factors so far, random walks, by a Kalman filter.

    rows also hold q (a step's variance), h (that of noise, above 0), b0_<f> and p0_<f> (where a key's slopes start), the
    same in all rows of a key. Rows with a null in any of these are left out; of rows of one order the lesser y goes first.
    """
    k, kept = len(factors), rows.columns
    need = [order, y, *factors, "q", "h", *(f"{p}_{f}" for p in ("b0", "p0") for f in factors)]
    ok = rows.dropna(subset=need).withColumn("_key", F.to_json(F.struct(*key)))
    ranged = written(ok.repartitionByRange("_key", order).withColumn("_range", F.spark_partition_id()))
    sort = ["_range", "_key", order, y, *factors]
    cut = ranged.groupBy("_range").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).orderBy("_range").collect()  # a row a range
    split = [(a._range, a.high) for a, b in zip(cut, cut[1:], strict=False) if a.high == b.low]

    def values(batch: pa.RecordBatch) -> tuple:
        column = lambda c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float)
        stack = lambda p: np.stack([column(p + f) for f in factors], axis=1)
        return column(y), stack(""), column("q"), column("h"), stack("b0_"), stack("p0_")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, now, start = None, 0, None, None

        def told() -> pa.RecordBatch:
            flat = np.concatenate([np.ravel(m) for m in (*start, *now)])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["_range", "n", "flat"])

        for batch in batches:
            ys, xs, qs, hs, b0, p0 = values(batch)
            for i, r in enumerate(batch.column("_range").to_pylist()):
                own = _step(ys[i], xs[i], qs[i], hs[i])
                if r != at:
                    if at is not None:
                        yield told()
                    at, n, now, start = r, 1, own, (b0[i], p0[i])
                else:
                    n, now = n + 1, _then(now, own)
        if at is not None:
            yield told()

    starts: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    if split:
        cuts = F.broadcast(rows.sparkSession.createDataFrame(split, "_range int, _key string"))  # a row a range
        told = ranged.join(cuts, ["_range", "_key"]).select(ranged.columns).repartition("_range").sortWithinPartitions(*sort)
        found = {r._range: (r.n, np.array(r.flat)) for r in told.mapInArrow(elements, "_range int, n long, flat array<double>").collect()}
        for i, one in enumerate(cut):
            if one._range in found:
                n, flat = found[one._range]
                b0, p0, a, b, c, eta, j = np.split(flat, np.cumsum([k, k, k * k, k, k * k, k]))
                before = starts.get(one._range) if one.low == one.high else None
                n0, mean, var = before or (0, b0, np.diag(p0))
                starts[cut[i + 1]._range] = (n0 + n, *_after(mean, var, (a.reshape(k, k), b, c.reshape(k, k), eta, j.reshape(k, k))))
    first = {r._range: r.low for r in cut if r._range in starts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, mean, var = None, 0, None, None
        for batch in batches:
            ys, xs, qs, hs, b0, p0 = values(batch)
            out, nth = np.empty((len(ys), 2 * k)), np.empty(len(ys), np.int64)
            for i, here in enumerate(zip(batch.column("_range").to_pylist(), batch.column("_key").to_pylist(), strict=True)):
                if here != at:
                    at = here
                    n, mean, var = starts[here[0]] if first.get(here[0]) == here[1] else (0, b0[i], np.diag(p0[i]))
                x, var = xs[i], var + qs[i] * np.eye(k)
                px = var @ x
                gain = px / (float(x @ px) + hs[i])
                n, mean, var = n + 1, mean + gain * (ys[i] - float(x @ mean)), var - np.outer(gain, px)
                nth[i], out[i, :k], out[i, k:] = n, mean, np.diag(var)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(nth), *(pa.array(c) for c in out.T)], names=[*kept, *more])

    more = ["nth", *(f"{p}_{f}" for p in ("beta", "var") for f in factors)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "nth long", *(f"`{c}` double" for c in more[1:])])
    return ranged.repartition("_range").sortWithinPartitions(*sort).mapInArrow(run, schema)


def kalman_beta(rows: DataFrame, q: float, h: float, key: str = "symbol", order: str = "trade_date", y: str = "y", x: str = "x") -> DataFrame:
    """Per symbol: the path of a time-varying slope of y on x (from 0, variance 1; steps of variance q, noise h), with each row's contribution beta x."""
    one = rows.select(key, order, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.lit(q).cast("double").alias("q"), F.lit(h).cast("double").alias("h"), F.lit(0.0).alias("b0_x"), F.lit(1.0).alias("p0_x"))
    return slope_paths(one, ["x"], [key], order).select(key, order, F.col("beta_x").alias("beta"), (F.col("beta_x") * F.col("x")).alias("contribution"))


def session_priors(rows: DataFrame, variances: DataFrame, min_rows: int, key: str = "symbol", session: str = "session", y: str = "y", market: str = "market", sector: str = "sector") -> DataFrame:
    """key, session, gamma, b0_/p0_ of market and sector, q, h: where a session's slopes start, from the key's session before alone.

    gamma is the sector's slope on the market; the sector counts less gamma times the market, so the two factors are
    orthogonal, and their slopes and squared errors follow from sums. variances: key, session, q, h of the level and the
    noise of log prices (local_level_em); the noise of returns is what of q the market doesn't explain, at least a tenth,
    and twice h. Sessions of under min_rows complete rows, or without a factor that varies, give no prior.
    """
    c = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b)).alias(f"_{a}_{b}")
    ok = rows.dropna(subset=[y, market, sector]).select(key, session, F.col(y).alias("y"), F.col(market).alias("m"), F.col(sector).alias("s"))
    sums = ok.groupBy(key, session).agg(F.count("*").alias("_n"), F.var_samp("m").alias("_vm"), c("y", "y"), c("m", "m"), c("s", "s"), c("y", "m"), c("y", "s"), c("m", "s"))
    gamma = F.col("_m_s") / F.nullif(F.col("_m_m"), F.lit(0.0))
    ss = F.col("_s_s") - F.col("gamma") * F.col("_m_s")
    told = sums.withColumn("gamma", gamma).withColumn("_ss", F.when(ss > 1e-12 * F.col("_s_s"), ss))
    told = told.withColumn("b0_market", F.col("_y_m") / F.col("_m_m")).withColumn("b0_sector", (F.col("_y_s") - F.col("gamma") * F.col("_y_m")) / F.col("_ss"))
    left = F.greatest(F.col("_y_y") - F.col("b0_market") ** 2 * F.col("_m_m") - F.col("b0_sector") ** 2 * F.col("_ss"), F.lit(0.0)) / F.greatest(F.col("_n") - 2, F.lit(1))
    told = told.withColumn("p0_market", left / F.col("_m_m")).withColumn("p0_sector", left / F.col("_ss"))
    both = told.join(variances.select(key, session, F.col("q").alias("_q"), F.col("h").alias("_h")), [key, session])
    noise = F.greatest(F.col("_q") - F.col("b0_market") ** 2 * F.col("_vm"), 0.1 * F.col("_q")) + 2 * F.col("_h")
    both = both.withColumn("h", noise).withColumn("q", F.col("h") / (F.nullif(F.col("_vm"), F.lit(0.0)) * F.col("_n") * F.col("_n")))
    # A row a session: the next one of the key is the one that starts here, whether or not it has a prior of its own.
    days = rows.select(key, session).distinct().withColumn("_next", F.lead(session).over(Window.partitionBy(key).orderBy(session)))
    names = ["gamma", "b0_market", "b0_sector", "p0_market", "p0_sector", "q", "h"]
    return both.where(F.col("_n") >= min_rows).join(days.where("_next IS NOT NULL"), [key, session]).select(key, F.col("_next").alias(session), *names).dropna()


def two_factor_beta(rows: DataFrame, priors: DataFrame, key: str = "symbol", session: str = "session", order: str = "ts", y: str = "y", market: str = "market", sector: str = "sector") -> DataFrame:
    """key, session, order, nth, market, sector (less gamma times the market), and beta_ and var_ of both, for sessions that have a prior."""
    names = ["q", "h", "b0_market", "b0_sector", "p0_market", "p0_sector"]
    own = rows.select(key, session, order, F.col(y).cast("double").alias("y"), F.col(market).cast("double").alias("market"), F.col(sector).cast("double").alias("sector")).join(priors, [key, session])
    own = own.withColumn("sector", F.col("sector") - F.col("gamma") * F.col("market"))
    return slope_paths(own.select(key, session, order, "y", "market", "sector", *names), ["market", "sector"], [key, session], order).drop("y", *names)


def path_contributions(paths: DataFrame, factors: Sequence[str] = ("market", "sector"), key: Sequence[str] = ("symbol", "session"), min_rows: int = 3) -> DataFrame:
    """Per path: of each factor f the <f>_contribution (sum of beta x), its 95 % half-width <f>_ci, and <f>_quarters, the mean slopes in the path's four quarters (the first take what doesn't divide). Paths of under min_rows rows are left out."""
    counts = paths.groupBy(*key).agg(F.max("nth").alias("n")).where(F.col("n") >= min_rows)
    whole, rest = F.floor(F.col("n") / 4), F.col("n") % 4
    early = rest * (whole + 1)
    quarter: Column = F.when(F.col("nth") <= early, F.ceil(F.col("nth") / (whole + 1))).otherwise(rest + F.ceil((F.col("nth") - early) / F.nullif(whole, F.lit(0))))
    sums = [a for f in factors for a in (F.sum(F.col(f"beta_{f}") * F.col(f)).alias(f"_c_{f}"), F.sum(F.col(f"var_{f}") * F.col(f) ** 2).alias(f"_v_{f}"), F.avg(f"beta_{f}").alias(f"_b_{f}"))]
    each = paths.join(counts, list(key)).withColumn("_quarter", quarter).groupBy(*key, "n", "_quarter").agg(*sums)
    # At most four rows a path.
    out = [a for f in factors for a in (F.sum(f"_c_{f}").alias(f"{f}_contribution"), (1.96 * F.sqrt(F.sum(f"_v_{f}"))).alias(f"{f}_ci"), F.array_sort(F.collect_list(F.struct("_quarter", f"_b_{f}"))).getField(f"_b_{f}").alias(f"{f}_quarters"))]
    return each.groupBy(*key, "n").agg(*out)
