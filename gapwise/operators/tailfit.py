"""Tail models: decluster, fit, calibrate, re-estimate."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tails import adaptive_level, tail_threshold
from ..scale import (
    attach,
    chunk_column,
    durable,
    is_cut,
    join_on,
    quantiles,
    running_sum,
    scan,
    setting,
    split,
    spread,
    table_quantiles,
    tiers,
    total,
    union_all,
    weighted,
)
from .groups import numbered, whole_groups
from .statistics import resolve_tiers, tier_levels

CANDIDATES = (0.9, 0.93, 0.95, 0.975, 0.99)
XI_RANGE = (-0.9, 0.95)


def calibration_rows(df: DataFrame, first: int | None = None, between: tuple[float, float] | None = None,
                     index: str = "row_index", epoch: str = "epoch_s") -> DataFrame:
    """All rows, the first rows by index, or an inclusive time range."""
    if between is not None:
        return df.where(F.col(epoch).between(*between))
    if first is not None:
        # the index of the last wanted row bounds the rows that are ranked, and only the index is looked at for it
        per = df.groupBy(index).agg(F.count(F.lit(1)).alias("_n"))
        upto = scan(durable(per), [], [index], {"_upto": running_sum("_n")}).withColumn("_before", F.col("_upto") - F.col("_n"))
        start = upto.where(F.col("_before") < first).select(index, "_before")
        near = join_on(df, start, [index], "inner")
        return scan(near, [index], [index], {"_no": running_sum(F.lit(1))}).where(F.col("_before") + F.col("_no") <= first).select(*df.columns)
    return df


# declustering -----------------------------------------------------------------


def _greedy(idx: np.ndarray, start: int, r: int) -> np.ndarray:
    keep, i = [], start
    while i < len(idx):
        keep.append(i)
        i = int(np.searchsorted(idx, idx[i] + r, side="right"))
    return np.array(keep, dtype=int)


def decluster(df: DataFrame, keys: Sequence[str], index: str, r: int) -> DataFrame:
    """Keep a row when its index is more than ``r`` after the last kept one.

    The chain is sequential, but the only thing a chunk needs from earlier rows
    is the last kept index, and only its first r positions depend on it.  So
    each chunk reports where it ends for each possible start, the chunks of a
    key are chained on those reports, and then all chunks are thinned in
    parallel.
    """
    keys = list(keys)
    df = split(df, keys, index)
    chunk = chunk_column(keys, index)
    cut = is_cut(df, keys, index)
    part = keys + ([chunk] if cut else [])
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # last kept index of the key that the frame before ended in
        for pdf in frames:
            keep = np.zeros(len(pdf), dtype=bool)
            for i, (no, at, before) in enumerate(zip(*[pdf[c].tolist() for c in ("_no", index, "_last")], strict=True)):
                if no == 1:
                    last = None if before is None or before != before else before
                if last is None or at > last + r or (at != at and last == last):  # rows without an index come last and count once
                    keep[i], last = True, at
            yield pdf[keep].drop(columns=["_last", "_no"])

    def report(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        idx = np.sort(pdf[index].to_numpy())
        n = int(np.searchsorted(idx, idx[0] + r, side="right")) + 1
        starts = list(range(min(n, len(idx))))
        ends = [int(idx[_greedy(idx, s, r)[-1]]) for s in starts]
        return pd.DataFrame([[*group, [int(idx[s]) for s in starts], ends]])

    if cut:
        hot = df.where(F.col(chunk) >= 0).select(*dict.fromkeys([*part, index]))
        fields = ", ".join([f"`{c}` {types[c]}" for c in part] + ["_starts array<bigint>", "_ends array<bigint>"])
        reports = spread(hot, part).groupBy(*part).applyInPandas(report, fields)
        earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)

        def follow(last, rep):
            blocked = F.size(F.filter(rep["_starts"], lambda s: s <= last + r))
            return F.when(blocked >= F.size(rep["_starts"]), last).otherwise(F.element_at(rep["_ends"], blocked + 1))

        never = F.lit(-(2**62)).cast("bigint")
        chain = F.aggregate(F.collect_list(F.struct("_starts", "_ends")).over(earlier), never, follow)
        starts = durable(reports.select(*part, F.nullif(chain, never).alias("_last")))  # one row per chunk of a hot key
        df = join_on(df, F.broadcast(starts), part)
    else:
        df = df.withColumn("_last", F.lit(None).cast("bigint"))
    return numbered(df, part, [index]).mapInPandas(thin, schema).drop(chunk)


# fitting ------------------------------------------------------------------------

#: The profile likelihood has one variable, w = ln(1 + xi max(y) / beta).  The first grid covers it (a mean excess of the
#: heaviest tail that a double holds lies inside); each next one covers the two steps around the best point so far.
FIRST = (-30.0, 2.5, 53)
STEPS = (0.125, 6.25e-3, 3.125e-4, 1.5625e-5)
POINTS = 41


def _per_row_cost(w: float, m: float, top: float, mean: float, bounds: tuple[float, float]) -> float:
    """Negative log likelihood per excess at ``w``, xi being the best one there: the mean ``m`` of ln(1 + xi y / beta), bounded."""
    if abs(w) < 1e-12:
        return math.log(mean) + 1
    xi = min(bounds[1], max(bounds[0], m))
    return math.log(xi * top / math.expm1(w)) + (1 + 1 / xi) * m


def fit_excesses(y: np.ndarray, n: np.ndarray, xi_eps: float, bounds=XI_RANGE) -> tuple[float, float, str]:
    """T17 for one bounded sample of weighted excesses, as kept in the state of a stream; see ``fit_tails``."""
    size, top = float(n.sum()), float(y.max())
    mean = float((n * y).sum() / size)
    if not (top > 0 and math.isfinite(top)):
        return 0.0, max(mean, 1e-6), "quantile"

    def means(ws: np.ndarray) -> np.ndarray:
        return np.log1p(np.expm1(ws)[:, None] / top * y[None, :]) @ n / size

    def grid(ws: np.ndarray) -> tuple[int, list[float]]:
        with np.errstate(divide="ignore"):
            costs = [_per_row_cost(w, m, top, mean, bounds) for w, m in zip(ws, means(ws), strict=True)]
        return int(np.argmin(costs)), costs

    ws = FIRST[0] + FIRST[1] * np.arange(FIRST[2])
    best, costs = grid(ws)
    for step in STEPS:
        ws = ws[best] + step * (np.arange(POINTS) - POINTS // 2)
        best, costs = grid(ws)
    w = float(ws[best])
    if 0 < best < POINTS - 1:
        bend = costs[best - 1] - 2 * costs[best] + costs[best + 1]
        if bend > 0:
            w += STEPS[-1] * (costs[best - 1] - costs[best + 1]) / (2 * bend)
    xi = min(bounds[1], max(bounds[0], float(means(np.array([w]))[0])))
    if abs(w) < 1e-12 or abs(xi) < xi_eps:
        return 0.0, max(mean, 1e-9), "mle"
    return xi, max(xi * top / math.expm1(w), 1e-9), "mle"


def _fit_groups(y: np.ndarray, n: np.ndarray, first: np.ndarray, xi_eps: float, bounds: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """xi, beta and whether a maximum was found, for groups of finite weighted excesses that begin at ``first``; see ``fit_tails``."""
    lengths = np.diff(np.append(first, len(y)))
    size, top = np.add.reduceat(n, first), np.maximum.reduceat(y, first)
    mean, each = np.add.reduceat(n * y, first) / size, np.arange(len(first))

    def means(w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(n * np.log1p(np.repeat(np.expm1(w) / top, lengths) * y), first) / size

    def cost(w: np.ndarray) -> np.ndarray:
        m = means(w)
        xi = np.clip(m, *bounds)
        ratio = xi * top / np.expm1(w)
        c = np.where(np.abs(w) < 1e-12, np.log(mean) + 1, np.log(np.where(ratio > 0, ratio, np.nan)) + (1 + 1 / xi) * m)
        return np.where(np.isnan(c), np.inf, c)

    with np.errstate(all="ignore"):
        w = np.full(len(first), FIRST[0])
        for step in (None, *STEPS):
            offsets = FIRST[1] * np.arange(FIRST[2]) if step is None else step * (np.arange(POINTS) - POINTS // 2)
            costs = np.stack([cost(w + o) for o in offsets])
            best = np.argmin(costs, axis=0)
            w = w + offsets[best]
        before, here, after = (costs[np.clip(best + k, 0, POINTS - 1), each] for k in (-1, 0, 1))
        bend = before - 2 * here + after
        inner = (best > 0) & (best < POINTS - 1) & (bend > 0) & np.isfinite(bend)
        w = w + np.where(inner, STEPS[-1] * (before - after) / (2 * bend), 0.0)
        xi = np.clip(means(w), *bounds)
        fitted = (top > 0) & ~np.isnan(xi)
        flat = (np.abs(w) < 1e-12) | (np.abs(xi) < xi_eps)
        beta = np.where(fitted & ~flat, np.maximum(xi * top / np.expm1(w), 1e-9), np.maximum(mean, np.where(fitted, 1e-9, 1e-6)))
    return np.where(fitted & ~flat, xi, 0.0), beta, fitted


def fit_tails(exc: DataFrame, keys: Sequence[str], xi_eps: float = 1e-6, bounds=XI_RANGE) -> DataFrame:
    """Xi, beta and estimator per key from weighted excesses (keys, y, n), for groups of any size.

    For a fixed ratio of xi and beta the likelihood is largest where xi is the mean of ln(1 + xi y / beta), so one variable
    remains.  Its likelihood is evaluated on a grid, the grid is refined around the best point four times, and a parabola
    through the last three points gives the maximum.  Groups that a task may hold (``gapwise.hot.rows``) are shuffled once and
    take all these steps in one call for the groups of an Arrow batch; larger ones take the same steps by one aggregate each.

    A group with a positive excess always has such a maximum inside the bounds, so the estimators that stand behind it in
    the chain (weighted and plain moments, which need a positive excess too) have nothing left to do; a group without one has
    xi 0 and its mean, estimator ``quantile``.
    """
    keys = list(keys)
    exc = durable(exc.select(*keys, F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("n")).where("y >= 0"))
    if not keys:
        return _fit_large(exc, keys, xi_eps, bounds)
    hot = (F.count(F.lit(1)) > setting(exc.sparkSession, "gapwise.hot.rows")) | (F.max("y") >= float("inf"))  # NaN is above it
    # at most the rows / hot.rows, and groups with an infinite excess
    large = durable(exc.groupBy(*keys).agg(hot.alias("_hot")).where("_hot").select(*keys))
    if large.isEmpty():
        return _fit_small(exc, keys, xi_eps, bounds)
    small = _fit_small(join_on(exc, F.broadcast(large), keys, "left_anti"), keys, xi_eps, bounds)
    return small.unionByName(_fit_large(durable(join_on(exc, F.broadcast(large), keys, "left_semi")), keys, xi_eps, bounds))


def _fit_small(exc: DataFrame, keys: list[str], xi_eps: float, bounds: tuple[float, float]) -> DataFrame:
    """Groups that fit a task: one call per Arrow batch with all its groups."""
    found = [T.StructField("xi", T.DoubleType()), T.StructField("beta", T.DoubleType()), T.StructField("estimator", T.StringType())]
    own = T.StructType([*[exc.schema[k] for k in keys], *found])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches):
            y, n = (table.column(c).to_numpy() for c in ("y", "n"))
            xi, beta, fitted = _fit_groups(y, n, first, xi_eps, bounds)
            of_first = [table.column(k).combine_chunks().take(pa.array(first)) for k in keys]
            kind = pa.array(np.where(fitted, "mle", "quantile").tolist(), pa.string())
            yield from pa.Table.from_arrays([*of_first, pa.array(xi), pa.array(beta), kind], names=own.names).to_batches()

    return numbered(exc, keys, ["y"]).select(*keys, "y", "n", "_no").mapInArrow(fit, own)


def _fit_large(exc: DataFrame, keys: list[str], xi_eps: float, bounds: tuple[float, float]) -> DataFrame:
    """The same fit for large groups: one aggregate over all of them per grid."""
    kept = ["_size", "_mean", "_top"]
    total_n = F.sum("n")
    base = exc.groupBy(*keys).agg(total_n.alias("_size"), (F.sum(F.col("n") * F.col("y")) / total_n).alias("_mean"), F.max("y").alias("_top"))
    w, top, size = F.col("_w"), F.when(F.col("_top") > 0, F.col("_top")), F.col("_size")

    def means(state: DataFrame, ws: list) -> DataFrame:
        rows = attach(exc, state, keys, "inner")
        each = [F.sum(F.col("n") * F.log1p(F.expm1(x) / top * F.col("y"))) for x in ws]
        out = rows.groupBy(*keys).agg(F.array(*each).alias("_sums"), *[F.max(c).alias(c) for c in [*kept, "_w"]])
        return out.withColumn("_m", F.transform("_sums", lambda x: x / size)).drop("_sums")

    def cost(at, m):
        xi = F.least(F.greatest(m, F.lit(bounds[0])), F.lit(bounds[1]))
        inner = F.ln(xi * top / F.expm1(at)) + (1 + 1 / xi) * m
        return F.when(F.abs(at) < 1e-12, F.ln(F.when(F.col("_mean") > 0, F.col("_mean"))) + 1).otherwise(inner)

    def refined(state: DataFrame, offsets: list[float], last: bool = False) -> DataFrame:
        found = means(state, [w + o for o in offsets])
        places = F.array(*[w + F.lit(o) for o in offsets])
        pairs = F.zip_with(places, "_m", lambda at, m: F.struct(cost(at, m).alias("cost"), at.alias("at")))
        found = found.withColumn("_all", pairs).withColumn("_best", F.array_min(F.filter("_all", lambda p: p["cost"].isNotNull())))
        at = F.col("_best")["at"]
        if last:
            i = F.array_position("_all", F.col("_best")).cast("int") - 1
            before, here, after = [F.get("_all", i + k)["cost"] for k in (-1, 0, 1)]
            bend = before - 2 * here + after
            at = at + F.coalesce(F.when(bend > 0, STEPS[-1] * (before - after) / (2 * bend)), F.lit(0.0))
        return found.select(*keys, *kept, at.alias("_w"))

    state = refined(base.withColumn("_w", F.lit(FIRST[0])), [FIRST[1] * k for k in range(FIRST[2])])
    for step in STEPS:
        state = refined(state, [step * (k - POINTS // 2) for k in range(POINTS)], last=step == STEPS[-1])
    done = means(state, [w])
    xi = F.least(F.greatest(F.get("_m", F.lit(0)), F.lit(bounds[0])), F.lit(bounds[1]))
    flat = (F.abs(w) < 1e-12) | (F.abs(xi) < xi_eps)
    fitted = w.isNotNull() & xi.isNotNull() & ~F.isnan(xi)
    return done.select(
        *keys,
        F.when(fitted & ~flat, xi).otherwise(0.0).alias("xi"),
        F.when(fitted & ~flat, F.greatest(xi * top / F.expm1(w), F.lit(1e-9)))
        .when(fitted, F.greatest("_mean", F.lit(1e-9)))
        .otherwise(F.greatest("_mean", F.lit(1e-6)))
        .alias("beta"),
        F.when(fitted, "mle").otherwise("quantile").alias("estimator"),
    )


# thresholds ---------------------------------------------------------------------


def spot_threshold(
    df: DataFrame, keys: Sequence[str], value: str, side: str = "both", u_quantile: float = 0.98, q: float = 1e-3,
    min_exceed: int = 50, calib_frac: float = 1.0, index: str | None = None, **_,
) -> DataFrame:
    """Peaks over threshold on the first part of each group's rows, both tails."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    if index is not None and calib_frac < 1:
        rows = scan(rows, keys, [index], {"_i": running_sum(F.lit(1)), "_n": total(F.lit(1))})
        size = F.least(F.greatest(F.ceil(F.col("_n") * calib_frac), F.lit(min_exceed + 1)), F.col("_n"))
        rows = rows.where(F.col("_i") <= size)
    wanted = [s for s in ("upper", "lower") if side in (s, "both")]
    tails = F.array(*[F.struct(F.lit(s).alias("tail"), (F.col(value) * (1.0 if s == "upper" else -1.0)).alias("x")) for s in wanted])
    rows = rows.select(*keys, F.explode(tails).alias("_t")).select(*keys, "_t.*")
    by = [*keys, "tail"]
    u = durable(quantiles(rows, by, "x", {"u": u_quantile}, size="n"))
    over = attach(rows, u.select(*by, "u"), by, "inner").where("x > u").select(*by, (F.col("x") - F.col("u")).alias("y"))
    exc = durable(weighted(over, by, "y"))
    size = exc.groupBy(*by).agg(F.sum("n").alias("n_exc"))
    enough = attach(exc, size.where(F.col("n_exc") >= min_exceed).select(*by), by, "inner")
    fit = fit_tails(enough, by, xi_eps=1e-8, bounds=(-0.49, 10.0))
    out = attach(attach(u, size, by), fit, by)
    p = F.coalesce(F.col("n_exc"), F.lit(0)) / F.col("n")
    level = F.when(F.lit(q) >= p, F.col("u")).otherwise(tail_threshold(F.col("u"), F.col("xi"), F.col("beta"), p, q, limit=1e-8))
    out = out.withColumns({"_tau": F.when(F.col("xi").isNotNull(), level), "_why": F.when(F.col("xi").isNull(), F.concat("tail", F.lit("_insufficient_exceedances")))})
    return out.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("tail") == "upper", F.col("_tau"))).alias("tau_hi"),
        F.max(F.when(F.col("tail") == "lower", -F.col("_tau"))).alias("tau_lo"),
        F.max("_why").alias("reason"),
    )


def calibrate(
    df: DataFrame, keys: Sequence[str], value: str, index: str = "row_index", candidates: Sequence[float] = CANDIDATES,
    min_tail: int = 50, q: float = 1e-3, r: int = 5, xi_eps: float = 1e-6,
) -> DataFrame:
    """Tail parameters per key, chosen among candidate base quantiles.

    All (key, candidate) pairs are processed together: base levels from ranks,
    the rows above them (only those are copied per candidate), one fit and one
    thinning, then the pick over the few candidates of a key.
    """
    keys = list(keys)
    ps = sorted({p for p in candidates if 0 < p < 1})
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), index)
    wv = durable(weighted(rows, keys, "x"))
    t = scan(wv, keys, ["x"], {"upto": running_sum("n"), "total": total("n")})
    us = [f"u{i}" for i in range(len(ps))]
    last = F.col("upto") > F.greatest(F.col("total") - min_tail, F.lit(0))  # the value that leaves fewer than min_tail rows above it
    spare = {"x_spare": F.min(F.when(last, F.col("x"))), "m_spare": F.max(F.when(last, F.col("total") - F.col("upto")))}
    base = durable(table_quantiles(t, keys, "x", dict(zip(us, ps, strict=True)), "simple", size="n", more=spare))
    above = [F.sum(F.when(F.col("x") > F.col(u), F.col("_w"))).alias(f"m_{u}") for u in us]
    above = attach(wv.withColumnRenamed("n", "_w"), base.select(*keys, *us), keys, "inner").groupBy(*keys).agg(*above)
    base = attach(base, above, keys)

    def level(u: str):
        """Candidate level, lowered where fewer than ``min_tail`` rows lie above it."""
        few = (F.coalesce(F.col(f"m_{u}"), F.lit(0)) < min_tail) & (F.col("n") >= min_tail)
        lower = F.least(F.col(u), F.col("x_spare"))
        left = F.when(F.col("x_spare") < F.col(u), F.col("m_spare")).otherwise(F.coalesce(F.col(f"m_{u}"), F.lit(0)))
        return F.when(few & (left < min_tail), lower - (F.abs(lower) * 1e-6 + 1e-9)).when(few, lower).otherwise(F.col(u))

    # behind this a (key, candidate) goes by its number
    base = base.select(*keys, "n", F.array(*[level(u) for u in us]).alias("_u"), (F.monotonically_increasing_id() * len(ps)).alias("_first"))
    base = durable(base)
    cand = F.array(*[
        F.struct((F.col("_first") + i).alias("_id"), F.lit(i).alias("c"), F.lit(p).alias("p0"), F.get("_u", F.lit(i)).alias("u")) for i, p in enumerate(ps)
    ])
    levels = base.select(*keys, "n", F.explode(cand).alias("_c")).select(*keys, "n", "_c.*")

    over = attach(rows, base.select(*keys, F.col("_u"), "_first"), keys, "inner").where(F.col("x") > F.array_min("_u"))
    over = over.select("x", index, "_first", F.posexplode("_u").alias("_i", "u")).where("x > u")
    over = durable(over.select((F.col("_first") + F.col("_i")).alias("_id"), index, (F.col("x") - F.col("u")).alias("y")))
    exc = weighted(over, ["_id"], "y")
    sums = exc.groupBy("_id").agg(F.sum("n").alias("n_exc"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("mean_residual"))
    fit = fit_tails(exc, ["_id"], xi_eps)
    kept = decluster(over.select("_id", index), ["_id"], index, r).groupBy("_id").agg(F.count(F.lit(1)).alias("clusters"))
    c = attach(attach(attach(levels, sums, ["_id"]), fit, ["_id"]), kept, ["_id"])
    c = c.fillna({"n_exc": 0, "mean_residual": 0.0, "clusters": 0, "xi": 0.0, "beta": 1e-6, "estimator": "quantile"})
    theta = F.when(F.col("clusters") > 0, F.greatest(F.col("clusters") / F.greatest("n_exc", F.lit(1)), F.lit(1e-6))).otherwise(1.0)
    c = c.withColumns({"theta": theta, "p_ref": F.col("clusters") / F.col("n")})
    c = c.withColumn("q_star", F.least(F.lit(q) / F.greatest("theta", F.lit(1e-6)), F.lit(1.0)))
    w = Window.partitionBy(*keys).orderBy("c")  # a handful of candidates per key
    pxi, pb = F.lag("xi").over(w), F.lag("beta").over(w)
    parts = F.when(pxi.isNull(), F.abs("xi") + F.abs("beta")).otherwise(
        F.abs(F.col("xi") - pxi) + F.abs(F.col("beta") - pb) / (F.abs("beta") + F.abs(pb) + 1e-9)
    )
    c = c.withColumn("stability", F.abs("mean_residual") + parts + F.when(F.col("estimator") == "mle", 0.0).otherwise(1.0))
    few_w = F.array(
        F.when(F.col("n_exc") == 0, "no_exceedances"),
        F.when(F.col("n_exc") < min_tail, "exceedances_below_min_tail"),
        F.when(F.col("n_exc") < min_tail, "residuals_below_min_tail"),
        F.when((F.col("n_exc") > 0) & (F.col("n_exc") < min_tail), "insufficient_tail_samples"),
        F.when(F.col("estimator") != "mle", F.concat("estimator", F.lit("_used"))),
    )
    c = c.withColumn("warnings", F.filter(few_w, lambda x: x.isNotNull()))
    every = Window.partitionBy(*keys)
    hi, lo, m = F.max("stability").over(every), F.min("stability").over(every), F.count(F.lit(1)).over(every)
    c = c.withColumns({"_hi": hi, "_lo": lo, "_m": m})
    norm = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("_hi") - F.col("stability")) / (F.col("_hi") - F.col("_lo")))
    x = F.when(F.col("_m") > 1, F.col("c") / (F.col("_m") - 1)).otherwise(0.0)
    c = c.withColumn("_score", norm - x)
    take = F.struct("u", "xi", "beta", "theta", "p_ref", "n", "n_exc", "mean_residual", "q_star", "p0", "estimator", "warnings")
    best = F.max_by(take, F.struct("_score", -F.col("c")))
    calm = F.min_by(take, F.struct("stability", "c"))
    picked = c.groupBy(*keys).agg(F.when(F.max("_score") <= 0, calm).otherwise(best).alias("_b"))
    return picked.select(*keys, "_b.*")


def calibrate_sample(
    x: np.ndarray, idx: np.ndarray, candidates: Sequence[float] = CANDIDATES, min_tail: int = 50, q: float = 1e-3,
    r: int = 5, xi_eps: float = 1e-6,
) -> dict[str, float | str]:
    """T16 for one bounded sample, as kept in the state of a stream."""
    n = len(x)
    s = np.sort(x)
    found = []
    for p in sorted({p for p in candidates if 0 < p < 1}):
        np_ = n * p
        if np_ != math.floor(np_):
            u = s[math.ceil(np_) - 1]
        else:
            i = int(np_)
            u = s[i] if n % 2 else (s[i - 1] + s[i]) / 2
        if (x > u).sum() < min_tail <= n:
            u = min(u, s[max(n - min_tail, 0)])
            if (x > u).sum() < min_tail:
                u -= abs(u) * 1e-6 + 1e-9
        over = x > u
        m = int(over.sum())
        y, counts = np.unique(x[over] - u, return_counts=True)
        xi, beta, kind = fit_excesses(y, counts.astype(float), xi_eps) if m else (0.0, 1e-6, "quantile")
        at = np.sort(idx[over])
        kept = len(_greedy(at, 0, r)) if m else 0
        theta = max(kept / m, 1e-6) if kept else 1.0
        resid = float((x[over] - u).mean()) if m else 0.0
        prev = found[-1] if found else None
        move = abs(xi - prev["xi"]) + abs(beta - prev["beta"]) / (abs(beta) + abs(prev["beta"]) + 1e-9) if prev else abs(xi) + abs(beta)
        found.append(
            {"u": float(u), "xi": xi, "beta": beta, "theta": theta, "p_ref": kept / n, "q_star": min(q / theta, 1.0),
             "estimator": kind, "stability": abs(resid) + move + (kind != "mle")}
        )
    st = np.array([f["stability"] for f in found])
    norm = np.ones(len(st)) if st.max() == st.min() else (st.max() - st) / (st.max() - st.min())
    score = norm - (np.arange(len(st)) / (len(st) - 1) if len(st) > 1 else 0.0)
    return found[int(np.argmin(st))] if score.max() <= 0 else found[int(np.argmax(score))]


def calibrate_tiers(
    df: DataFrame, value: str, user: str = "uid", category: str = "op_category", index: str = "row_index", min_tail: int = 50, **options
) -> DataFrame:
    """Tail parameters of each (user, category), its user or everyone, with warnings."""
    rows = tiers(df.select(user, category, value, index), [user, category], tier_levels(user, category))
    stats = durable(calibrate(rows, ["level", user, category], value, index, min_tail=min_tail, **options))
    size = stats.where("level = 'global'").select("n").first()
    if size is None or size["n"] < min_tail:
        raise ValueError("too few rows for the global tail model")
    out = resolve_tiers(stats, user, category, min_tail, need_user=False)
    extra = F.when(F.col("source_op_category") != F.col(category), F.array(F.lit("group_spot_insufficient_samples"), F.concat(F.lit("group_spot_fallback_"), "tier")))
    return out.withColumn("warnings", F.concat("warnings", F.coalesce(extra, F.array().cast("array<string>"))))


def reestimate(
    df: DataFrame, entries: DataFrame, keys: Sequence[str], value: str, index: str = "row_index", every: int = 10_000,
    min_exceed: int = 5, min_tail: int = 50, **options,
) -> DataFrame:
    """Parameters per entry and epoch; an epoch is ``every`` consecutive rows of an entry.

    The rows of an epoch that exceed its base level give the parameters of the
    next one, if there are enough of them.  ``tau`` never falls from epoch to
    epoch, except to the end point of a bounded tail (C4).  Epochs are
    sequential by definition; all entries advance together.
    """
    keys = list(keys)
    names = ["u", "xi", "beta", "theta", "p_ref", "q_star"]
    rows = scan(df.select(*keys, value, index), keys, [index], {"_i": running_sum(F.lit(1))})
    rows = durable(rows.withColumn("epoch", F.floor((F.col("_i") - 1) / every).cast("int")).select(*keys, value, index, "epoch"))
    last = rows.agg(F.max("epoch")).first()[0] or 0
    level = adaptive_level(*[F.col(c) for c in ("u", "xi", "beta", "p_ref", "q_star")])
    end = F.when(F.col("xi") < 0, F.col("u") - F.col("beta") / F.when(F.col("xi") != 0, F.col("xi"))).otherwise(float("inf"))
    current = entries.select(*keys, *names).withColumns({"tau": level, "epoch": F.lit(0), "refit": F.lit(False)})
    current = durable(current)
    done = [current]
    full = rows.groupBy(*keys, "epoch").agg((F.count(F.lit(1)) == every).alias("_full"))
    for e in range(last):
        now = rows.where(F.col("epoch") == e)
        over = attach(now, current.select(*keys, "u"), keys, "inner").where(F.col(value) > F.col("u")).drop("u", "epoch")
        size = over.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
        ready = attach(size, full.where((F.col("epoch") == e) & F.col("_full")).select(*keys), keys, "inner")
        ready = ready.where((F.col("_m") >= min_exceed) & (F.col("_m") >= min_tail)).select(*keys)
        fresh = calibrate(attach(over, ready, keys, "inner"), keys, value, index, min_tail=min_tail, **options)
        fresh = fresh.select(*keys, F.struct(*names).alias("_f"))
        nxt = attach(current, fresh, keys)
        nxt = nxt.select(
            *keys, *[F.coalesce(F.col(f"_f.{c}"), F.col(c)).alias(c) for c in names], "tau",
            F.lit(e + 1).alias("epoch"), F.col("_f").isNotNull().alias("refit"),
        )
        current = durable(nxt.withColumn("tau", F.least(end, F.greatest(level, "tau"))))
        done.append(current)
    return union_all(done)


