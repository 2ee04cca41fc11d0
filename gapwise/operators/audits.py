"""Audits, profiles and smoothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import attach, first_of, join_on, previous, quantiles, running_sum, scan, total, trailing


def smooth_scores(
    df: DataFrame, keys: Sequence[str], score: str, window: int = 5, epoch: str = "epoch_s", index: str = "row_index"
) -> DataFrame:
    """Trailing mean, left edge filled with the first score; short groups stay as they are."""
    out = scan(
        df,
        keys,
        [epoch, index],
        {
            "_t": trailing(score, window, inclusive=True),
            "_f": first_of(score),
            "_n": total(F.lit(1)),
        },
    )
    filled = F.aggregate("_t", F.lit(0.0), lambda a, x: a + x) + (window - F.size("_t")) * F.col("_f")
    out = out.withColumn("smoothed", F.when(F.col("_n") < window, F.col(score)).otherwise(filled / window))
    return out.drop("_t", "_f", "_n")


def rotation_audit(
    df: DataFrame, epoch: str = "epoch_s", period_s: float = 86400.0, window_s: float = 300.0
) -> DataFrame:
    """Rows just before and after each boundary between consecutive files.

    A file is one period (day or hour).  A row can only touch the boundary at
    its period's start and end, so the range condition becomes two keys per row
    and counts are combined before they are shuffled.
    """
    file = F.floor(F.col(epoch) / period_s).cast("long")
    files = df.select(file.alias("file")).distinct()
    nxt = scan(files, [], ["file"], {"previous_file": previous("file")})
    bounds = nxt.where("previous_file IS NOT NULL").select(
        "previous_file", F.col("file").alias("next_file"), (F.col("file") * F.lit(period_s)).alias("boundary_s")
    )
    per_file = df.select(file.alias("file"), F.col(epoch).alias("t"))
    before = (
        join_on(per_file, bounds.select(F.col("previous_file").alias("file"), "boundary_s"), ["file"], "inner")
        .where(F.col("t").between(F.col("boundary_s") - window_s, F.col("boundary_s")))
        .groupBy("boundary_s")
        .agg(F.count(F.lit(1)).alias("previous_count"), F.min("t").alias("previous_min"), F.max("t").alias("previous_max"))
    )
    after = (
        join_on(per_file, bounds.select(F.col("next_file").alias("file"), "boundary_s"), ["file"], "inner")
        .where(F.col("t").between(F.col("boundary_s"), F.col("boundary_s") + window_s))
        .groupBy("boundary_s")
        .agg(F.count(F.lit(1)).alias("next_count"), F.min("t").alias("next_min"), F.max("t").alias("next_max"))
    )
    out = join_on(join_on(bounds, before, ["boundary_s"]), after, ["boundary_s"])
    out = out.fillna(0, ["previous_count", "next_count"]).withColumn("gap_s", F.col("next_min") - F.col("previous_max"))
    issues = F.array(
        F.when(F.col("previous_count") == 0, "missing_previous_window"),
        F.when(F.col("next_count") == 0, "missing_next_window"),
        F.when(F.col("gap_s") > window_s, "gap_exceeds_window"),
    )
    return out.withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))


def numeric_profile(df: DataFrame, columns: Sequence[str], unknown: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column: size, moments, quantiles, missing and unknown values.

    The columns are unpivoted once and aggregated by name; no rows give zeros and NULLs.
    """
    unknown = dict(unknown or {})
    cells = []
    for c in columns:
        seen = F.coalesce(F.lower(F.col(unknown[c])) == "unknown", F.lit(False)) if c in unknown else F.lit(False)
        cells.append(F.struct(F.lit(c).alias("column_name"), F.col(c).try_cast("double").alias("v"), seen.alias("u")))
    long = df.select(F.inline(F.array(*cells)))
    base = long.groupBy("column_name").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
        F.count_if(F.col("v").isNull()).alias("missing"),
        F.count_if("u").alias("unknown"),
    )
    q = quantiles(long.where("v IS NOT NULL"), ["column_name"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    out = join_on(join_on(names, base, ["column_name"]), q, ["column_name"])
    return out.fillna(0, ["n", "missing", "unknown"])


def profile_change(before: DataFrame, after: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Quantile differences, and whether q95 kept its unit (relative tolerance)."""
    cols = ["q25", "q50", "q75", "q95"]
    a = after.select("column_name", *[F.col(c).alias(f"{c}_after") for c in cols])
    out = join_on(before.select("column_name", *cols), a, ["column_name"], "inner")
    out = out.withColumns({f"{c}_diff": F.col(f"{c}_after") - F.col(c) for c in cols})
    rel = F.abs(F.col("q95_diff")) / F.greatest(F.abs(F.col("q95")), F.lit(1e-12))
    unit = F.col("column_name").rlike("(_ms|_bytes|_count)$") | F.col("column_name").contains("delta_t")
    return out.withColumn("unit_kept", F.when(unit, rel <= tolerance))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of usable values per column in one pass."""
    def bad(c):
        return F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin("", "null", "none", "na", "nan")

    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(bad(c)).alias(c) for c in columns])
    long = one.unpivot(["rows"], list(columns), "column_name", "missing")
    share = 1 - F.col("missing") / F.col("rows")
    return long.withColumn("completeness", share).withColumn("complete", F.col("missing") == 0)


def gap_statistics(df: DataFrame, keys: Sequence[str], value: str = "delta_seconds") -> DataFrame:
    """Size, moments, extremes and 95th percentile of gaps per key."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"),
    )
    q = quantiles(df.where(F.col(value).isNotNull()), keys, value, {"p95": 0.95})
    return join_on(base, q, keys) if keys else attach(base, q, [])


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, e.g. per anomaly type or session."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts and densities on the full grid; the last bin is closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    rows = attach(df.select(F.col(value).alias("v")).where("v IS NOT NULL"), ends, [])
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_bin"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = join_on(grid, counts, ["bin"]).withColumn("n_bin", F.coalesce("n_bin", F.lit(0)))
    return out.select(
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("left_edge"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("right_edge"),
        F.col("n_bin").alias("n"),
        F.when(width > 0, F.col("n_bin") / F.col("n") / width).alias("density"),
    )


def score_summary(df: DataFrame, value: str) -> DataFrame:
    """Moments and quantiles of scores."""
    base = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                  F.min(value).alias("lowest"), F.max(value).alias("highest"))
    q = quantiles(df.where(F.col(value).isNotNull()), [], value, {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return attach(base, q, [])


def threshold_conflicts(df: DataFrame, user: str = "uid", threshold: str = "threshold", tolerance: float = 1e-6) -> DataFrame:
    """Thresholds seen per user; a user with two different ones is a conflict."""
    return df.groupBy(user).agg(F.min(threshold).alias("lowest"), F.max(threshold).alias("highest")).withColumn(
        "conflict", F.coalesce(F.col("highest") - F.col("lowest") > tolerance, F.lit(False))
    )


def first_threshold(columns: Sequence[str]):
    """First usable threshold column of a row."""
    return F.coalesce(*[F.col(c).try_cast("double") for c in columns])


def audit_summary(df: DataFrame, findings: DataFrame, source: str, label: str = "time_label", user: str = "uid") -> DataFrame:
    """Sources, rows, users, findings and share of unknown labels."""
    labelled = F.coalesce(F.trim(label), F.lit("")) != ""
    base = df.agg(
        F.count_distinct(source).alias("files"),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(user).alias("users"),
        F.round(F.count_if(F.lower(F.trim(label)) == "unknown") / F.nullif(F.count_if(labelled), F.lit(0)), 6).alias("unknown_ratio"),
    )
    return attach(base, findings.agg(F.count(F.lit(1)).alias("findings")), [])


def response_metrics(
    df: DataFrame, keys: Sequence[str], t: str = "t", r: str = "r", y: str = "y", tolerance: float = 0.02
) -> DataFrame:
    """Integral errors, rise, settling, overshoot and final error per series.

    A step is a reference change above 1 % of its largest magnitude; a single
    one makes a step response and the last one is measured.
    """
    keys = list(keys)
    eps = 2.220446049250313e-16
    rows = scan(df, keys, [t], {"_t0": previous(t), "_r0": previous(r), "_y0": previous(y), "_i": running_sum(F.lit(1))})
    peak = df.groupBy(*keys).agg(F.max(F.abs(r)).alias("_peak"))
    rows = join_on(rows, peak, keys)
    dt = F.col(t) - F.col("_t0")
    e1, e0 = F.col(r) - F.col(y), F.col("_r0") - F.col("_y0")
    jump = F.abs(F.col(r) - F.col("_r0")) > F.greatest(F.lit(1e-12), 0.01 * F.col("_peak"))
    rows = rows.withColumn("_jump", F.coalesce(jump, F.lit(False)))
    base = rows.groupBy(*keys).agg(
        F.sum(dt * (F.abs(e1) + F.abs(e0)) / 2).alias("iae"),
        F.sum(dt * (e1 * e1 + e0 * e0) / 2).alias("ise"),
        F.sum(dt * (F.abs(e1) * F.col(t) + F.abs(e0) * F.col("_t0")) / 2).alias("itae"),
        F.count_if("_jump").alias("steps"),
        F.max(F.when(F.col("_jump"), F.col("_i"))).alias("_at"),
        F.max_by(F.when(F.col("_jump"), F.col("_r0")), F.when(F.col("_jump"), F.col("_i"))).alias("_from"),
        F.max_by(r, t).alias("_to"),
        F.max_by(y, t).alias("_ylast"),
    )
    amp = F.col("_to") - F.col("_from")
    seg = join_on(rows, base.select(*keys, "_at", "_from", "_to", amp.alias("_amp")), keys).where(
        F.col("_i") >= F.col("_at") - 1
    )  # the segment starts on the row before the jump
    first = F.col("_i") == F.col("_at") - 1
    sign = F.signum("_amp")

    def crossing(share: float):
        level = F.col("_from") + share * F.col("_amp")
        met = (F.abs(F.col("_amp")) >= eps) & (F.when(sign >= 0, F.col(y) >= level).otherwise(F.col(y) <= level))
        slope = F.col(y) - F.col("_y0")
        at = F.when(first | (slope == 0), F.col(t)).otherwise(
            F.col("_t0") + (level - F.col("_y0")) * dt / F.when(slope != 0, slope)
        )
        return F.min_by(F.when(met, at), F.when(met, F.col("_i")))

    band = tolerance * F.greatest(F.abs("_amp"), F.lit(eps))
    outside = F.abs(F.col(y) - F.col("_to")) > band
    marked = scan(seg.withColumn("_out", outside), keys, [t], {"_prev_out": previous("_out")})
    per = marked.groupBy(*keys).agg(
        crossing(0.1).alias("_t10"),
        crossing(0.9).alias("_t90"),
        F.min(t).alias("_start"),
        F.max(t).alias("_end"),
        F.max(F.when(F.col("_out"), F.col("_i"))).alias("_last_out"),
        F.max(F.when(F.coalesce("_prev_out", F.lit(False)), F.col(t))).alias("_after_out"),
        F.max("_i").alias("_n"),
        F.max(F.when(F.abs(F.col("_amp")) < eps, 0.0).otherwise((F.col(y) - F.col("_to")) / F.col("_amp"))).alias("_over"),
    )
    settle = (
        F.when(F.col("_last_out").isNull(), F.col("_start"))
        .when(F.col("_last_out") == F.col("_n"), F.col("_end"))
        .otherwise(F.col("_after_out"))
    )
    out = join_on(base, per, keys)
    return out.select(
        *keys, "iae", "ise", "itae", (F.col("steps") == 1).alias("is_step"),
        (F.col("_t90") - F.col("_t10")).alias("rise_time"),
        F.when(F.col("_at").isNotNull(), settle).alias("settling_time"),
        (F.col("_over") * 100).alias("overshoot_pct"),
        (F.col("_to") - F.col("_ylast")).alias("steady_state_error"),
    )
