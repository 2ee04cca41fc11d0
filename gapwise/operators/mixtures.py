"""One against two normal components on ln x, for all groups at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import attach, durable, join_on, ranked
from .groups import numbered, whole_groups

# fixed values of the test
LEAST_ROWS, ROUNDS, TOLERANCE = 6, 128, 1e-6
WEIGHT_FLOOR, VAR_FLOOR, SEPARATION = 0.1, 1e-6, 0.75
#: weighted values of one group that a single task may hold
GROUP_LIMIT = 200_000


class _Fits:
    """Two components for many groups: one number per group in each array, all groups move in the same rounds.

    Means are kept as distances from the mean of the group.
    """

    def __init__(self, size, mean, var, m1, m2):
        self.size, self.mean, self.var = size, mean, np.maximum(var, VAR_FLOOR)
        self.w1, self.m1, self.m2 = np.full(len(size), 0.5), m1 - mean, m2 - mean
        self.v1, self.v2 = self.var.copy(), self.var.copy()
        self.empty = np.zeros(len(size), bool)
        self.live = np.flatnonzero(size >= LEAST_ROWS)

    def odds(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Terms of the log odds of the second component in the groups ``at``: base + h1 (c - m1)^2 - h2 (c - m2)^2."""
        w1, m1, m2, v1, v2 = (a[at] for a in (self.w1, self.m1, self.m2, self.v1, self.v2))
        return np.log(1 - w1) - np.log(w1) + 0.5 * np.log(v1 / v2), m1, m2, 0.5 / v1, 0.5 / v2

    def move(self, s1, s2, m1, m2, v1, v2) -> None:
        """Take the next weights, means and variances of the live groups; those that stop moving or run empty leave."""
        at = self.live
        with np.errstate(all="ignore"):
            full = (s1 > 0) & (s2 > 0)
            w1 = np.minimum(1 - WEIGHT_FLOOR, np.maximum(WEIGHT_FLOOR, s1 / self.size[at]))
            v1, v2 = np.maximum(VAR_FLOOR, v1), np.maximum(VAR_FLOOR, v2)
            shift = np.zeros(len(at))
            for own, new in ((self.w1, w1), (self.m1, m1), (self.m2, m2), (self.v1, v1), (self.v2, v2)):
                shift = np.maximum(shift, np.abs(new - own[at]))
                own[at[full]] = new[full]
        self.empty[at[~full]] = True
        self.live = at[full & ~(shift < TOLERANCE)]

    def difference(self, single: np.ndarray, double: np.ndarray) -> np.ndarray:
        """BIC difference from both log likelihoods; NaN where the components are not apart."""
        with np.errstate(all="ignore"):
            apart = np.abs(self.m1 - self.m2)
            pooled = np.sqrt(np.maximum(VAR_FLOOR, (self.v1 + self.v2) / 2))
            ok = (self.size >= LEAST_ROWS) & ~self.empty & (apart >= SEPARATION * pooled) & (apart >= SEPARATION * np.sqrt(self.var))
            out = -2 * single + 2 * np.log(self.size) - (-2 * double + 5 * np.log(self.size))
        return np.where(ok & np.isfinite(out), out, np.nan)


def _first_means(a3, b3, a4, b4) -> tuple[np.ndarray, np.ndarray]:
    """Thirds, where they are equal quarters, where these are equal too a little apart."""
    thirds, off = a3 != b3, np.where(a4 == b4, 1e-3, 0.0)
    return np.where(thirds, a3, a4 - off), np.where(thirds, b3, b4 + off)


def _test_groups(x: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BIC difference of each group of weighted values, NaN for none; ``first`` are the places where groups begin.

    The values of a group follow each other in ascending order.
    """
    lengths = np.diff([*first, len(x)])
    size, upto = np.add.reduceat(n, first), np.cumsum(n)
    before = upto[first] - n[first]

    def at(rank: np.ndarray) -> np.ndarray:
        return x[np.searchsorted(upto, before + np.minimum(np.maximum(rank, 0), size - 1), side="right")]

    with np.errstate(all="ignore"):
        mean = np.add.reduceat(n * x, first) / size
        c = x - np.repeat(mean, lengths)
        var = np.add.reduceat(n * c * c, first) / size
    start = _first_means(at(size // 3 - 1), at(2 * size // 3), at(size // 4), at(3 * size // 4))
    fits = _Fits(size, mean, var, *start)
    held = None
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            if not len(fits.live):
                break
            if held is None or len(fits.live) < 0.8 * len(held):
                held = fits.live
                inside = np.zeros(len(size), bool)
                inside[held] = True
                rows = np.repeat(inside, lengths)
                hc, hn, many = c[rows], n[rows], lengths[held]
                starts = np.cumsum(many) - many
            base, m1, m2, h1, h2 = (np.repeat(t, many) for t in fits.odds(held))
            r = hn / (1 + np.exp(np.clip(base + h1 * (hc - m1) ** 2 - h2 * (hc - m2) ** 2, -700, 700)))
            q = hn - r
            s1, s2 = np.add.reduceat(r, starts), np.add.reduceat(q, starts)
            m1, m2 = np.add.reduceat(r * hc, starts) / s1, np.add.reduceat(q * hc, starts) / s2
            v1 = np.add.reduceat(r * (hc - np.repeat(m1, many)) ** 2, starts) / s1
            v2 = np.add.reduceat(q * (hc - np.repeat(m2, many)) ** 2, starts) / s2
            own = np.searchsorted(held, fits.live)
            fits.move(*(a[own] for a in (s1, s2, m1, m2, v1, v2)))

        def density(m, v):
            return -0.5 * (np.repeat(np.log(2 * math.pi * v), lengths) + (c - np.repeat(m, lengths)) ** 2 / np.repeat(v, lengths))

        single = np.add.reduceat(n * density(np.zeros(len(size)), fits.var), first)
        lp1 = np.repeat(np.log(fits.w1), lengths) + density(fits.m1, fits.v1)
        lp2 = np.repeat(np.log(1 - fits.w1), lengths) + density(fits.m2, fits.v2)
        double = np.add.reduceat(n * np.logaddexp(lp1, lp2), first)
    return fits.difference(single, double)


def _test_small(wv: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that fit a task: one call per Arrow batch with all its groups."""
    own = T.StructType([*[wv.schema[k] for k in keys], T.StructField("bic_difference", T.DoubleType())])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches):
            x, n = (table.column(c).to_numpy().astype(float) for c in ("l", "n"))
            value = pa.array(_test_groups(x, n, first), pa.float64(), from_pandas=True)
            of_first = [table.column(k).combine_chunks().take(pa.array(first)) for k in keys]
            yield from pa.Table.from_arrays([*of_first, value], names=own.names).to_batches()

    return numbered(wv, keys, ["l"]).select(*keys, "l", "n", "_no").mapInArrow(test, own)


def _test_large(wv: DataFrame, keys: list[str]) -> DataFrame:
    """The same test for large groups: one aggregate over all of them per round.

    These groups are few, at most the rows / ``group_limit``; their numbers are kept beside the rounds.
    """
    t = ranked(wv, keys, "l")
    size = F.col("total")

    def at(rank):
        return F.min(F.when(F.col("upto") > F.greatest(F.lit(0), F.least(rank, size - 1)), F.col("l")))

    start = t.groupBy(*keys).agg(
        F.max("total").alias("size"),
        (F.sum(F.col("n") * F.col("l")) / F.sum("n")).alias("mean"),
        at(F.floor(size / 3) - 1).alias("a3"), at(F.floor(2 * size / 3)).alias("b3"),
        at(F.floor(size / 4)).alias("a4"), at(F.floor(3 * size / 4)).alias("b4"),
    )
    start = durable(durable(start).coalesce(1).withColumn("_g", F.monotonically_increasing_id()))
    rows = attach(wv, F.broadcast(start.select(*keys, "_g", "mean")) if keys else start.select("_g", "mean"), keys, "inner")
    rows = durable(rows.select("_g", (F.col("l") - F.col("mean")).alias("c"), F.col("n").cast("double").alias("n")))

    def numbers(df: DataFrame) -> dict[str, np.ndarray]:
        data = sorted(df.collect(), key=lambda r: r["_g"])
        return {c: np.array([math.nan if r[c] is None else r[c] for r in data], int if c == "_g" else float) for c in df.columns}

    def with_numbers(at: np.ndarray, **columns: np.ndarray) -> DataFrame:
        """Rows of the groups ``at`` with their numbers."""
        form = ", ".join(["_g long", *[f"{c} double" for c in columns]])
        data = [tuple(v.item() for v in row) for row in zip(at, *columns.values(), strict=True)]
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(data, form)), "_g")

    p = numbers(start.select("_g", "size", "mean", "a3", "b3", "a4", "b4"))
    c, n = F.col("c"), F.col("n")
    var = numbers(rows.groupBy("_g").agg((F.sum(n * c * c) / F.sum(n)).alias("var")))["var"]
    fits = _Fits(p["size"], p["mean"], var, *_first_means(p["a3"], p["b3"], p["a4"], p["b4"]))
    for _ in range(ROUNDS):
        if not len(fits.live):
            break
        base, m1, m2, h1, h2 = fits.odds(fits.live)
        each = with_numbers(fits.live, base=base, m1=m1, m2=m2, h1=h1, h2=h2)
        d1, d2 = c - F.col("m1"), c - F.col("m2")
        odds = F.col("base") + F.col("h1") * d1 * d1 - F.col("h2") * d2 * d2
        each = each.withColumn("r", n / (1 + F.exp(F.least(F.lit(700.0), odds))))
        r, q = F.col("r"), n - F.col("r")
        sums = numbers(each.groupBy("_g").agg(
            F.sum(r).alias("s1"), F.sum(q).alias("s2"), F.sum(r * c).alias("x1"), F.sum(q * c).alias("x2"),
            F.sum(r * c * c).alias("q1"), F.sum(q * c * c).alias("q2"),
        ))
        with np.errstate(all="ignore"):
            c1, c2 = sums["x1"] / sums["s1"], sums["x2"] / sums["s2"]
            fits.move(sums["s1"], sums["s2"], c1, c2, sums["q1"] / sums["s1"] - c1 * c1, sums["q2"] / sums["s2"] - c2 * c2)

    def density(m, v):
        d = c - F.col(m)
        return -0.5 * (F.ln(F.lit(2 * math.pi) * F.col(v)) + d * d / F.col(v))

    with np.errstate(all="ignore"):
        one = {"zero": np.zeros(len(fits.size)), "var": fits.var}
        each = with_numbers(p["_g"], **one, u1=np.log(fits.w1), u2=np.log(1 - fits.w1), m1=fits.m1, m2=fits.m2, v1=fits.v1, v2=fits.v2)
    lp1, lp2 = F.col("u1") + density("m1", "v1"), F.col("u2") + density("m2", "v2")
    top = F.greatest(lp1, lp2)
    both = top + F.ln(F.exp(lp1 - top) + F.exp(lp2 - top))
    ll = numbers(each.groupBy("_g").agg(F.sum(n * density("zero", "var")).alias("l1"), F.sum(n * both).alias("l2")))
    found = [(int(g), None if math.isnan(v) else float(v)) for g, v in zip(p["_g"], fits.difference(ll["l1"], ll["l2"]), strict=True)]
    values = rows.sparkSession.createDataFrame(found, "_g long, bic_difference double")
    return start.join(F.broadcast(values), "_g").select(*keys, "bic_difference")


def bimodality(wv: DataFrame, keys: Sequence[str], group_limit: int = GROUP_LIMIT) -> DataFrame:
    """BIC difference of one against two components per key; NULL when not separated.

    Groups with up to ``group_limit`` weighted values are tested inside a task, many groups
    in one call, larger ones by aggregates over all of them; both follow the same steps and give the
    same value, NULL also where a component runs empty.
    """
    # own names, so that no column made on the way replaces a key (T11 calls one of its keys _g)
    keys, given = [f"_key{i}" for i in range(len(keys))], list(keys)
    wv = wv.select(*[F.col(k).alias(own) for own, k in zip(keys, given, strict=True)], "l", "n")
    wv = durable(wv.groupBy(*keys, "l").agg(F.sum("n").alias("n")))
    # at most the rows / group_limit
    large = durable(wv.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > group_limit))
    if large.isEmpty():
        out = _test_small(wv, keys)
    elif not keys:
        out = _test_large(wv, keys)
    else:
        marked = F.broadcast(large.select(*keys))
        small = _test_small(join_on(wv, marked, keys, "left_anti"), keys)
        out = small.unionByName(_test_large(durable(join_on(wv, marked, keys, "left_semi")), keys))
    return out.select(*[F.col(own).alias(k) for own, k in zip(keys, given, strict=True)], "bic_difference")
