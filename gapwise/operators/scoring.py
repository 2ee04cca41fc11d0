"""Scores, p-values, fused scores and alarms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chisq import weighted_fisher_neg_log10
from ..functions.tails import (
    adaptive_level,
    fisher_neg_log10,
    hazard_quantile_time,
    hazard_survival,
    neg_log10,
    tail_probability,
)
from ..scale import at_least, at_most, attach, join_on, ranked, weighted
from .latches import clearing_latch, ratio_latch
from .statistics import lookup


def closed_points(cdf: Column) -> Column:
    """(p, value) points in order, closed with 0 and 1 just outside the ends."""
    pts = F.array_sort(F.transform(cdf, lambda c: F.struct(c["value"].alias("v"), c["p"].alias("p"))))
    first, last = F.element_at(pts, 1)["v"], F.element_at(pts, -1)["v"]
    low = first - F.greatest(F.abs(first) * 1e-6, F.lit(1e-9))
    high = last + F.greatest(F.abs(last) * 1e-6, F.lit(1e-9))
    below = F.array(F.struct(low.alias("v"), F.lit(0.0).alias("p")))
    above = F.array(F.struct(high.alias("v"), F.lit(1.0).alias("p")))
    return F.concat(below, pts, above)


def cdf_position(x: Column, points: Column) -> Column:
    """Interpolated share of values up to x, one walk over the closed points."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("v"), none.alias("p"), none.alias("at"))

    def walk(a, c):
        slope = (c["p"] - a["p"]) / F.when(c["v"] != a["v"], c["v"] - a["v"])
        here = F.coalesce(a["p"] + (x - a["v"]) * slope, c["p"])
        found = F.when(a["at"].isNotNull(), a["at"]).when(x <= c["v"], here)
        return F.struct(c["v"].alias("v"), c["p"].alias("p"), found.alias("at"))

    share = F.aggregate(points, start, walk, lambda a: F.coalesce(a["at"], F.lit(1.0)))
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def breach_severity(x: Column, hi: Column, lo: Column) -> Column:
    """Ratio beyond the threshold, 1 inside."""
    up = x / F.greatest(hi, F.lit(1e-9))
    down = F.greatest(F.abs(lo), F.lit(1e-9)) / F.greatest(F.abs(x), F.lit(1e-9))
    return F.when(x > hi, up).when(x < lo, down).otherwise(1.0)


def alarm_reason(x: Column, hi: Column, lo: Column, latched: Column) -> Column:
    """Which detector speaks; the latch alone is ``spot_upper``."""
    q = F.when((x > hi) & (x < lo), "both").when(x > hi, "quantile_upper").when(x < lo, "quantile_lower").otherwise("")
    return F.when(latched & (q == ""), "spot_upper").when(latched, "both").otherwise(q)


def score_rows(
    rows: DataFrame,
    quantile_stats: DataFrame,
    tail_stats: DataFrame,
    value: str = "delta_seconds",
    domain: str = "log_dt",
    index: str = "row_index",
    k: int = 3,
    n: int = 5,
    h: float = 1.1,
) -> DataFrame:
    """C1-C5 with L4: the scored row.

    The latch runs over the rows of one resolved tail entry in input order; rows
    of unseen users share the global entry.
    """
    stats = quantile_stats.withColumn("points", closed_points(F.col("cdf")))
    out = lookup(rows, stats, ["tau_hi", "tau_lo", "points"]).drop("lookup_level")
    tail = ["u", "xi", "beta", "p_ref", "theta", "q_star", "estimator"]
    key = F.concat_ws("||", "uid", "op_category")
    # the level is a matter of the entry, so it is computed once for each and not for each of its rows
    level = adaptive_level(*[F.col(c) for c in ("u", "xi", "beta", "p_ref", "q_star")])
    entries = tail_stats.withColumns({"entry": key, "tau_t": at_least(F.exp(level), 1e-12)})
    out = lookup(out, entries, [*tail, "entry", "tau_t"]).drop("lookup_level")
    x, y = F.col(value), F.greatest(F.col(domain) - F.col("u"), F.lit(0.0))
    p = tail_probability(y, F.col("xi"), F.col("beta"), F.col("p_ref"))
    out = out.withColumn("p_lower", cdf_position(x, F.col("points")))
    out = out.withColumns(
        {
            "p_upper_quantile": 1 - F.col("p_lower"),
            "s_q": breach_severity(x, F.col("tau_hi"), F.col("tau_lo")),
            "p_upper_spot": F.least(F.lit(1.0), p),
            "side": F.when(F.col(domain) >= F.col("u"), "upper").otherwise("lower"),
            "tau_classic": F.col("beta") / F.greatest(1 - F.col("xi"), F.lit(1e-6)),
        }
    )
    out = out.withColumns(
        {"s_evt": at_least(x, 0.0) / F.col("tau_t"), "neglog10_p": neg_log10(F.col("p_upper_spot"))}
    ).drop("points")
    out = clearing_latch(out, ["entry"], [index], "s_evt", k, n, h)
    return out.withColumn("alarm_reason", alarm_reason(x, F.col("tau_hi"), F.col("tau_lo"), F.col("alarm")))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Thresholds of the key, else the global row (NULL keys); flag includes equality."""
    cols = [c for c in ("tau_hi", "tau_lo", "applied_method", "group_level") if c in thresholds.columns]
    pack = F.struct(*cols)
    own = thresholds.where(F.col(keys[0]).isNotNull()).select(*keys, pack.alias("_o"))
    glob = thresholds.where(F.col(keys[0]).isNull()).select(pack.alias("_g"))
    out = attach(join_on(df, own, list(keys)), glob, []).withColumn("_c", F.coalesce("_o", "_g"))
    out = out.select("*", *[F.col(f"_c.{c}").alias(c) for c in cols]).drop("_o", "_g", "_c")
    x = F.col(value)
    flag = F.coalesce(x >= F.col("tau_hi"), F.lit(False)) | F.coalesce(x <= F.col("tau_lo"), F.lit(False))
    return out.withColumn("anomaly_label", flag.cast("int"))


def hazard_scores(
    df: DataFrame, g: Column, w: Column, delta: str, keys: Sequence[str], order: Sequence[str], q: float = 0.05,
    censored: Column | None = None, k: int = 1, n: int = 1, h: float = 1.1,
) -> DataFrame:
    """Survival of the gap under hazard exp(g + w t), alarm ratio and latch."""
    cens = F.coalesce(censored, F.lit(False)) if censored is not None else F.lit(False)
    s = hazard_survival(g, w, F.col(delta))
    out = df.withColumns({"survival": s, "tau_q": hazard_quantile_time(g, w, q)})
    out = out.withColumns(
        {
            "p_time": 1 - F.col("survival"),
            "ratio": F.coalesce(F.col(delta) / F.when(F.col("tau_q") > 0, F.col("tau_q")), F.lit(0.0)),
            "raw_alarm": F.coalesce(~cens & (F.col("survival") <= q) & F.col("tau_q").isNotNull(), F.lit(False)),
        }
    )
    out = out.withColumn("lead_time", F.when(F.col("raw_alarm"), F.greatest(F.col(delta) - F.col("tau_q"), F.lit(0.0))))
    return ratio_latch(out, keys, order, "raw_alarm", "ratio", k, n, h)


def fuse(a: Column, b: Column, weights: tuple[float, float] = (1.0, 1.0)) -> Column:
    """Two -log10(p) scores combined; equal weights use the closed form."""
    if abs(weights[0] - 1) < 1e-8 and abs(weights[1] - 1) < 1e-8:
        return fisher_neg_log10(a, b)
    return weighted_fisher_neg_log10(a, b, *weights)


def budget_threshold(df: DataFrame, keys: Sequence[str], score: str, budget: float) -> DataFrame:
    """C14: score of the floor(n * budget)-th largest row; infinity when that is none."""
    t = ranked(weighted(df, keys, score), keys, score)
    k = F.floor(F.col("total") * F.lit(budget))
    at = F.min(F.when(F.col("upto") > F.col("total") - k, F.col(score)))
    out = t.groupBy(*keys).agg(at.alias("threshold"), F.max("total").alias("n"))
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))


def apply_calibration(df: DataFrame, calibration: DataFrame, keys: Sequence[str], score: str, alarm: str = "alarm") -> DataFrame:
    """C14: frozen thresholds used on other rows."""
    t = calibration.select(*keys, F.col("threshold").alias("_t"))
    return attach(df, t, list(keys)).withColumn(alarm, (F.col(score) >= F.col("_t")).cast("int")).drop("_t")


def session_vote(df: DataFrame, session: str, score: str, limit: float, votes: int) -> DataFrame:
    """A session is anomalous when enough of its rows exceed the limit."""
    over = F.count_if(F.col(score) > limit)
    return df.groupBy(session).agg(F.count(F.lit(1)).alias("events"), over.alias("exceeding")).withColumn(
        "anomalous", F.col("exceeding") >= votes
    )


def unit(c: Column) -> Column:
    return at_least(at_most(c, 1.0), 0.0)
