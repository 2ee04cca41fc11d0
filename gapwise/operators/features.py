"""Inter-event-time features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import utc_hour
from ..scale import (
    at_least,
    at_most,
    attach,
    durable,
    first_of,
    join_on,
    last_seen,
    level_stats,
    median_mad,
    previous,
    running_sum,
    scan,
    tiers,
    trailing,
    union_all,
)
from .contract import clip

SCALE = 1.4826  # deviation of a normal distribution per median absolute deviation
Z_FACTOR = 0.6744897501960817


def r7_of(sorted_values: Column, q: float) -> Column:
    """Linearly interpolated quantile of a short sorted array, NULL when empty."""
    n = F.size(sorted_values)
    pos = (n - 1) * F.lit(float(q))
    low = F.floor(pos).cast("int")
    a = F.try_element_at(sorted_values, F.when(n > 0, low + 1))
    b = F.try_element_at(sorted_values, F.when(n > 0, F.least(low + 2, n)))
    return a + (pos - low) * (b - a)


def session_position(
    df: DataFrame, keys: Sequence[str] = ("uid", "session_id"), epoch: str = "epoch_s", index: str = "row_index"
) -> DataFrame:
    """Sequence number, elapsed time and start flag inside the session."""
    out = scan(df, keys, [epoch, index], {"_n": running_sum(F.lit(1)), "_first": first_of(epoch)})
    return out.withColumns(
        {
            "session_sequence": F.col("_n") - 1,
            "session_elapsed_seconds": F.greatest(F.col(epoch) - F.col("_first"), F.lit(0.0)),
            "is_session_start": F.col("_n") == 1,
        }
    ).drop("_n", "_first")


def log_burst(
    df: DataFrame,
    epsilon: float,
    keys: Sequence[str] = ("uid", "session_id"),
    epoch: str = "epoch_s",
    index: str = "row_index",
    bound: float = 5.0,
) -> DataFrame:
    """Log ratio of the previous to the current gap of two measured rows in a row."""
    ready = (F.col("time_label") == "measured") & (F.col("session_sequence") > 0)
    out = scan(df, keys, [epoch, index], {"_pd": previous(F.when(ready, F.col("delta_seconds")))})
    ratio = (F.col("_pd") + epsilon) / (F.col("delta_seconds") + epsilon)
    return out.withColumn("delta_log_burst", F.when(ready, clip(F.ln(ratio), bound))).drop("_pd")


def rolling_quantiles(
    df: DataFrame,
    value: str = "delta_clipped_seconds",
    levels: Mapping[str, float] = {"delta_m25": 0.25, "delta_m50": 0.5, "delta_m75": 0.75},
    n: int = 10,
    keys: Sequence[str] = ("uid", "session_id"),
    epoch: str = "epoch_s",
    index: str = "row_index",
) -> DataFrame:
    """Quantiles of the last n measured gaps before a row, NULL without history."""
    keys, order = list(keys), [epoch, index]
    out = df.withColumn("_m", F.col("time_label") == "measured")
    out = scan(out, [*keys, "_m"], order, {"_t": trailing(value, n, inclusive=True)})
    out = out.withColumn("_t", F.when(F.col("_m"), F.col("_t")))
    out = scan(out, keys, order, {"_h": last_seen("_t")}).withColumn("_h", F.array_sort("_h"))
    return out.withColumns({name: r7_of(F.col("_h"), q) for name, q in levels.items()}).drop("_m", "_t", "_h")


def gap_features(
    df: DataFrame, epsilon: float, clip_seconds: float = 300.0, window: int = 10
) -> DataFrame:
    """Per-row features of labelled gaps: W9, W10, W11 and the clipped gap.

    All windows share the user partitioning, so the rows are shuffled once.
    """
    out = df.withColumn("delta_clipped_seconds", at_most(F.col("delta_seconds"), clip_seconds))
    out = session_position(out)
    out = log_burst(out, epsilon)
    return rolling_quantiles(out, n=window)


def _side_by_side(stats: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Statistics of levels with the same keys as columns ``<level>_n/_med/_smad``."""
    cols = {"n": F.col("n"), "med": F.col("x_med"), "smad": F.col("x_mad") * SCALE}
    own = stats.where(F.col("level").isin(list(levels)))
    return own.groupBy(*keys).agg(
        *[F.max(F.when(F.col("level") == p, c)).alias(f"{p}_{name}") for p in levels for name, c in cols.items()]
    )


def robust_scores(
    df: DataFrame,
    epsilon: float,
    min_samples: int = 8,
    floor: float = 1e-9,
    bound: float = 5.0,
    user: str = "uid",
    session: str = "session_id",
    epoch: str = "epoch_s",
) -> DataFrame:
    """A5: robust z of the clipped gap and hour-adjusted z of its logarithm.

    Statistics come from (user, session), else user, else all rows; a level
    counts with ``min_samples`` values.  Hours without own values use the hour
    over all users, and then all hours.  All levels are computed in one pass and
    written once; they meet in one table per (user, session, hour), to which the
    rows are joined once.
    """
    x = "delta_clipped_seconds"
    keys = [user, session, "_hour"]
    rows = df.withColumn("_hour", utc_hour(F.col(epoch)))
    log_any = F.ln(at_least(F.col(x), epsilon) + epsilon)
    both = F.array(
        F.struct(F.lit(False).alias("_is_log"), F.col(x).alias("_v")),
        F.struct(F.lit(True).alias("_is_log"), F.when(F.col("time_label") == "measured", log_any).alias("_v")),
    )
    base = rows.select(*keys, F.explode(both).alias("_b")).select(*keys, "_b.*").where("_v IS NOT NULL")
    plain = {"g": [], "u": [user], "s": [user, session]}
    logs = {"lg": [], "lu": [user], "ls": [user, session]}
    logs |= {"hg": ["_hour"], "hu": [user, "_hour"], "hs": keys}
    parts = [tiers(base.where(F.col("_is_log") == is_log), keys, lv) for is_log, lv in ((False, plain), (True, logs))]
    stats = durable(median_mad(union_all(parts), ["level", *keys], "_v"))
    grid = rows.select(*keys).distinct()
    g = attach(grid, _side_by_side(stats, [], ["g", "lg"]), [])
    g = join_on(g, F.broadcast(_side_by_side(stats, ["_hour"], ["hg"])), ["_hour"])  # 24 rows
    g = join_on(g, _side_by_side(stats, [user], ["u", "lu"]), [user])
    g = join_on(g, _side_by_side(stats, [user, session], ["s", "ls"]), [user, session])
    g = join_on(g, _side_by_side(stats, [user, "_hour"], ["hu"]), [user, "_hour"])
    g = join_on(g, _side_by_side(stats, keys, ["hs"]), keys)
    g = join_on(rows, g, keys)

    def pick(what: str) -> Column:
        level = F.lit(None).cast("double")
        glob = at_least(F.col("g_smad"), floor) if what == "smad" else F.col("g_med")
        for p in ("u", "s"):
            own = F.when(F.col(f"{p}_smad") >= floor, F.col(f"{p}_{what}")).otherwise(glob)
            level = F.when(F.col(f"{p}_n") >= min_samples, own).otherwise(level)
        return F.coalesce(level, glob)

    def pick_hour(what: str) -> Column:
        base_value = at_least(F.col("lg_smad"), floor) if what == "smad" else F.col("lg_med")
        every = F.coalesce(F.col(f"hg_{what}"), base_value)
        level = every
        for p in ("u", "s"):
            level = F.when(
                F.col(f"l{p}_n") >= min_samples, F.coalesce(F.col(f"h{p}_{what}"), every)
            ).otherwise(level)
        return level

    z = (F.col(x) - pick("med")) / at_least(pick("smad"), 1e-12)
    zs = (log_any - pick_hour("med")) / at_least(pick_hour("smad"), floor)
    return g.select(
        *df.columns, clip(z, bound).alias("delta_robust_z"), clip(zs, bound).alias("delta_z_deseas_clipped")
    )


def fit_robust_stats(
    df: DataFrame, epsilon: float, keys: Sequence[str] = ("uid",), min_samples: int = 8, epoch: str = "epoch_s"
) -> DataFrame:
    """A4: log-domain median and scale per level and hour (24 rows per level and key).

    Rows: ``level`` (global or key), the key columns, ``hour`` (NULL = all
    hours), x_med, x_mad, x_smad.  An hour without values takes the global hour
    and then the all-hours statistics of its own level.
    """
    keys = list(keys)
    m = df.where(F.col("time_label") == "measured").select(
        *keys,
        utc_hour(F.col(epoch)).alias("hour"),
        F.ln(at_least(F.col("delta_seconds"), epsilon) + epsilon).alias("x"),
    )
    levels = {"g": [], "gh": ["hour"], "k": keys, "kh": [*keys, "hour"]}
    stats = durable(level_stats(m, [*keys, "hour"], levels, "x"))

    def of(level: str) -> DataFrame:
        return stats.where(F.col("level") == level).drop("level")

    def grid(base: DataFrame, hourly: DataFrame, on: Sequence[str]) -> DataFrame:
        full = base.drop("hour").withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        own = hourly.select(*on, "hour", F.col("x_med").alias("h_med"), F.col("x_mad").alias("h_mad"))
        return join_on(full, own, [*on, "hour"])

    base = of("k").where(F.col("n") >= min_samples)
    g = grid(of("g"), of("gh"), []).select(
        "hour", F.coalesce("h_med", "x_med").alias("g_med"), F.coalesce("h_mad", "x_mad").alias("g_mad")
    )
    k = join_on(grid(base, of("kh"), keys), F.broadcast(g), ["hour"])  # 24 rows
    out = union_all(
        [
            of("g").select(F.lit("global").alias("level"), "hour", "x_med", "x_mad"),
            g.select(F.lit("global").alias("level"), "hour", F.col("g_med").alias("x_med"), F.col("g_mad").alias("x_mad")),
            base.select(F.lit("key").alias("level"), *keys, "hour", "x_med", "x_mad"),
            k.select(
                F.lit("key").alias("level"),
                *keys,
                "hour",
                F.coalesce("h_med", "g_med", "x_med").alias("x_med"),
                F.coalesce("h_mad", "g_mad", "x_mad").alias("x_mad"),
            ),
        ]
    )
    return out.withColumn("x_smad", F.col("x_mad") * SCALE)


def user_log_scores(
    df: DataFrame, epsilon: float, key: str = "uid", value: str = "delta_seconds", bound: float = 5.0
) -> DataFrame:
    """Robust z of ln(gap + epsilon) per user; a zero scale becomes 1.4826 * epsilon."""
    x = df.withColumn("_x", F.ln(F.coalesce(F.col(value), F.lit(0.0)) + epsilon))
    out = join_on(x, median_mad(x, [key], "_x"), [key])
    scale = F.when(F.col("x_mad") > 0, F.col("x_mad") * SCALE).otherwise(SCALE * epsilon)
    return out.withColumn("log_robust_z", clip((F.col("_x") - F.col("x_med")) / scale, bound)).drop(
        "_x", "n", "x_med", "x_mad"
    )


def augmented_features(
    df: DataFrame,
    epsilon: float,
    overrides: Mapping[str, Column] | None = None,
    n: int = 12,
    bound: float = 5.0,
    levels: Mapping[str, float] = {"q50": 0.5, "q90": 0.9},
    session: str = "session_id",
    epoch: str = "epoch_s",
    index: str = "row_index",
    trail_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Z-scores against the whole set and the hour, and trailing statistics.

    ``dt_sec`` is the gap inside the session, floored at epsilon.  The trailing
    window holds the last n gaps including this one, per session by default; pass
    ``trail_keys=[]`` for one window over all rows in input order.
    ``overrides`` (X4) replaces a column by an expression before the columns
    that depend on it are computed.
    """
    overrides = dict(overrides or {})

    def put(d: DataFrame, name: str, e: Column) -> DataFrame:
        return d.withColumn(name, F.coalesce(overrides[name], e) if name in overrides else e)

    out = scan(df, [session], [epoch, index], {"_pt": previous(epoch)})
    gap = F.col(epoch) - F.col("_pt")
    out = put(out, "dt_sec", F.when(gap >= 0, at_least(gap, epsilon))).drop("_pt")
    out = put(out, "log_dt", F.ln(F.when(F.col("dt_sec") > 0, F.col("dt_sec"))))
    out = out.withColumn("_hour", utc_hour(F.col(epoch)))
    d = F.col("dt_sec")

    have = out.where(d.isNotNull()).select("_hour", "dt_sec")
    sets = {"g": [], "h": ["_hour"]}
    med = level_stats(have, ["_hour"], sets, "dt_sec")
    mom = tiers(have, ["_hour"], sets).groupBy("level", "_hour").agg(
        F.avg("dt_sec").alias("x_mean"), F.stddev_pop("dt_sec").alias("x_std")
    )
    stats = join_on(med, mom, ["level", "_hour"])  # 25 rows

    def of(p: str) -> DataFrame:
        cols = [F.col(c).alias(f"{p}{c}") for c in ("x_med", "x_mad", "x_mean", "x_std")]
        return stats.where(F.col("level") == p).select("_hour", *cols)

    full = join_on(attach(out, of("g").drop("_hour"), []), F.broadcast(of("h")), ["_hour"])
    full = put(full, "z", F.when(F.col("gx_std") > 0, (d - F.col("gx_mean")) / F.col("gx_std")).otherwise(d * 0))
    off = d - F.col("gx_med")
    full = put(full, "z_robust", F.when(F.col("gx_mad") > 0, Z_FACTOR * off / F.col("gx_mad")).otherwise(F.signum(off)))
    hoff = d - F.col("hx_med")
    wide = F.when(F.col("hx_std") > 0, F.col("hx_std")).when(F.col("hx_mad") > 0, F.col("hx_mad") * SCALE)
    full = put(full, "z_hourly", F.coalesce(hoff / wide, F.signum(hoff)))

    keys = [session] if trail_keys is None else list(trail_keys)
    order = [epoch, index] if trail_keys is None else [index]
    full = full.withColumn("_has", d.isNotNull())
    full = scan(full, [*keys, "_has"], order, {"_t": trailing("dt_sec", n, inclusive=True)})
    full = full.withColumn("_t", F.when(F.col("_has"), F.col("_t")))
    full = scan(full, keys, order, {"_w": last_seen("_t", inclusive=True)})
    full = full.withColumn("_w", F.array_sort("_w"))
    for name, q in levels.items():
        full = put(full, name, r7_of(F.col("_w"), q))
    logs = F.transform("_w", lambda x: F.ln(F.greatest(x, F.lit(float(epsilon)))))
    size = F.size("_w").cast("double")
    full = full.withColumn("_l", logs)
    mean = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x) / F.nullif(size, F.lit(0.0))
    full = put(full, "log_burst_mean", F.when(size > 0, mean))
    var = F.aggregate("_l", F.lit(0.0), lambda a, x: a + (x - F.col("log_burst_mean")) * (x - F.col("log_burst_mean")))
    full = put(full, "log_burst_std", F.when(size > 0, F.sqrt(var / size)))
    dev = F.col("log_dt") - F.col("log_burst_mean")
    # a window of equal gaps leaves only rounding noise in the deviation
    burst = F.when(F.col("log_burst_std") > 1e-12, dev / F.col("log_burst_std")).when(F.abs(dev) < 1e-12, 0.0).otherwise(F.signum(dev))
    full = put(full, "log_burst_z", burst)
    for name in ("z", "z_robust", "z_hourly", "log_burst_z"):
        c = F.col(name)
        full = put(full, f"{name}_clipped", F.when(c.isNotNull(), clip(c, bound)))
    drop = ["_hour", "_has", "_t", "_w", "_l"] + [f"{p}{c}" for p in "gh" for c in ("x_med", "x_mad", "x_mean", "x_std")]
    return full.drop(*drop)
