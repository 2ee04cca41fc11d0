"""Threshold estimators per group.

Every estimator maps (rows, keys, value) to one row per key.  Values are first
collapsed to weighted values, histograms have at most a few hundred bins, and
ranks come from the chunked scan, so the tier that covers all rows is a key
like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import tail_threshold
from ..scale import (
    at_most,
    attach,
    durable,
    join_on,
    previous,
    quantiles,
    ranked,
    running_sum,
    scan,
    table_quantiles,
    tiers,
    total,
    trailing,
    weighted,
)

MAX_BINS, MIN_BINS = 512, 32
TINY = 5e-324
SQRT2 = 2.0**0.5


def positive(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Weighted positive values with their logarithm: keys, x, l, n."""
    wv = weighted(df.where(F.col(value) > 0).select(*keys, F.col(value).cast("double").alias("x")), keys, "x")
    return wv.withColumn("l", F.ln("x"))


def log_layout(wv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Freedman-Diaconis bins of the logarithm, outward rounded to 9 decimals."""
    t = ranked(wv.select(*keys, "l", "x", "n"), keys, "l")
    q = table_quantiles(t, keys, "l", {"l25": 0.25, "l75": 0.75}, size="n_rows")
    ends = wv.groupBy(*keys).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    out = attach(q, ends, list(keys))
    low = F.floor(F.col("x_min") * 1e9) / 1e9
    low = F.when(low > 0, low).otherwise(F.col("x_min"))
    out = out.withColumns({"log_min": F.ln(low), "log_max": F.ln(F.ceil(F.col("x_max") * 1e9) / 1e9)})
    span = F.col("log_max") - F.col("log_min")
    iqr = F.col("l75") - F.col("l25")
    width = F.when(iqr > 0, 2 * iqr / F.cbrt(F.col("n_rows").cast("double"))).otherwise(span / MAX_BINS)
    bins = F.least(F.lit(MAX_BINS), F.greatest(F.lit(MIN_BINS), F.ceil(span / width))).cast("int")
    out = out.withColumn("bins", F.when(span > 0, bins).otherwise(1))
    return out.withColumn("width", F.when(span > 0, span / F.col("bins")).otherwise(0.0))


def _bin(x: Column, lo: Column, width: Column, bins: Column) -> Column:
    raw = F.floor((x - lo) / F.when(width > 0, width))
    return F.coalesce(F.greatest(F.lit(0), F.least(raw, bins - 1)), F.lit(0)).cast("int")


def log_histogram(wv: DataFrame, layout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-empty bins with counts and the layout of the key."""
    rows = join_on(wv, layout, list(keys)) if keys else attach(wv, layout, [])
    first = _bin(F.col("l"), F.col("log_min"), F.col("width"), F.col("bins"))
    # bin edges are rounded to 9 decimals of the value; move values across them
    def edge(i: Column) -> Column:
        return F.round(F.exp(F.col("log_min") + F.col("width") * i), 9)

    b = F.when((first < F.col("bins") - 1) & (F.col("x") >= edge(first + 1)), first + 1).when(
        (first > 0) & (F.col("x") < edge(first)), first - 1
    ).otherwise(first)
    cols = ["log_min", "log_max", "width", "bins", "n_rows"]
    return rows.groupBy(*keys, b.alias("bin")).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in cols])


def full_histogram(hist: DataFrame, layout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All bins with edges in seconds, empty ones included."""
    grid = layout.select(*keys, "log_min", "width", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    out = join_on(grid, hist.select(*keys, "bin", "n"), [*keys, "bin"])
    edge = F.col("log_min") + F.col("width") * F.col("bin")
    return out.select(
        *keys, "bin", F.exp(edge).alias("lo"), F.exp(edge + F.col("width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def best_cut(hist: DataFrame, keys: Sequence[str], center: Column) -> DataFrame:
    """Bin after which the variance between both sides is largest (first on ties).

    Empty bins repeat the value of the bin before, so only filled ones count.
    """
    c = hist.withColumn("_c", center)
    c = c.withColumns({"_s": F.col("n") * F.col("_c"), "_q": F.col("n") * F.col("_c") * F.col("_c")})
    c = scan(
        c,
        keys,
        ["bin"],
        {
            "cn": running_sum("n"), "cs": running_sum("_s"),
            "tn": total("n"), "ts": total("_s"), "tq": total("_q"),
        },
    )
    left, right = F.col("cn"), F.col("tn") - F.col("cn")
    gap = F.col("cs") / left - (F.col("ts") - F.col("cs")) / F.when(right > 0, right)
    between = left / F.col("tn") * (right / F.col("tn")) * gap * gap
    mean = F.col("ts") / F.col("tn")
    var = F.greatest(F.col("tq") / F.col("tn") - mean * mean, F.lit(0.0))
    c = c.withColumn("_b", between)
    # bins whose variances differ by rounding only count as equal
    key = F.struct(F.round(F.col("_b"), 12), -F.col("bin"))
    ok = F.col("_b").isNotNull()
    return c.groupBy(*keys).agg(
        F.max_by("bin", F.when(ok, key)).alias("cut_bin"),
        F.max("_b").alias("between"),
        F.max(var).alias("variance"),
        F.max("bin").alias("last_bin"),
    )


def otsu_log(hist: DataFrame, layout: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right edge of the best bin and share of explained variance."""
    center = F.col("log_min") + F.col("width") * (F.col("bin") + 0.5)
    cut = best_cut(hist, keys, center)
    out = attach(layout, cut, list(keys))
    found = F.coalesce(F.col("between") > 0, F.lit(False)) & (F.col("width") > 0)
    tau = at_most(F.col("log_min") + F.col("width") * (F.col("cut_bin") + 1), F.col("log_max"))
    return out.select(
        *keys,
        F.col("bins").alias("fd_bins"),
        F.when(found, tau).otherwise(F.col("log_min")).alias("tau_log"),
        F.when(found & (F.col("variance") > 0), F.col("between") / F.col("variance")).otherwise(0.0).alias("quality"),
    )


def _even_histogram(wv: DataFrame, keys: Sequence[str], x: str, bins: Column) -> tuple[DataFrame, DataFrame]:
    """Equal-width histogram of column x; ``bins`` may use n_rows."""
    ends = wv.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    ends = ends.withColumn("bins", bins.cast("int")).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    rows = attach(wv, ends, list(keys))
    b = _bin(F.col(x), F.col("lo"), F.col("width"), F.col("bins"))
    cols = ["lo", "hi", "width", "bins", "n_rows"]
    hist = rows.groupBy(*keys, b.alias("bin")).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in cols])
    return hist, ends


def otsu_linear(wv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Otsu on seconds, center of the best bin, 2..256 bins."""
    bins = F.least(F.lit(256), F.greatest(F.lit(2), F.floor(F.sqrt("n_rows"))))
    hist, ends = _even_histogram(wv, keys, "x", bins)
    cut = best_cut(hist, keys, F.col("lo") + F.col("width") * (F.col("bin") + 0.5))
    tau = F.col("lo") + F.col("width") * (F.col("cut_bin") + 0.5)
    out = attach(ends, cut, list(keys))
    return out.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise(tau).alias("tau"))


def otsu_log_even(wv: DataFrame, keys: Sequence[str], style: str = "detector") -> DataFrame:
    """T4: Otsu on ln x with square-root bins.

    ``detector``: 8..128 bins, middle of the best bin; ``loader``: 16..128 bins,
    its right edge.
    """
    root = F.sqrt("n_rows")
    if style == "detector":
        bins = F.greatest(F.lit(8), F.least(F.lit(128), F.floor(root + 0.5)))
    else:
        bins = F.least(F.lit(128), F.greatest(F.lit(16), F.floor(root)))
    hist, ends = _even_histogram(wv, keys, "l", bins)
    cut = best_cut(hist, keys, F.col("lo") + F.col("width") * (F.col("bin") + 0.5))
    out = attach(ends, cut, list(keys))
    shift = 0.5 if style == "detector" else 1.0
    flat = F.col("hi") - F.col("lo") <= 1e-12
    tau = F.col("lo") + F.col("width") * (F.col("cut_bin") + shift)
    still = F.col("hi") + 0.5e-12 if style == "detector" else F.col("hi")
    return out.select(*keys, "n_rows", F.exp(F.when(flat, still).otherwise(tau)).alias("tau"))


def otsu_gated(df: DataFrame, keys: Sequence[str], value: str, bins: int | None = None, side: str = "upper") -> DataFrame:
    """T5: Otsu that refuses flat, single-peaked and low-contrast values, with a reason.

    ``bins`` None uses Freedman-Diaconis.  The lower side mirrors the values.
    """
    sign = 1.0 if side == "upper" else -1.0
    src = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, (F.col(value) * sign).alias("x"))
    wv = weighted(src, keys, "x")
    t = ranked(wv, keys, "x")
    q = table_quantiles(t, keys, "x", {"x25": 0.25, "x75": 0.75}, size="n_q")
    m = src.groupBy(*keys).agg(F.var_pop("x").alias("var"))
    q = attach(q, m, list(keys))
    ends = wv.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = attach(ends, q, list(keys))
    if bins is None:
        width = 2 * (F.col("x75") - F.col("x25")) / F.pow(F.col("n_rows").cast("double"), F.lit(1 / 3))
        fd = F.greatest(F.lit(2), F.ceil((F.col("hi") - F.col("lo")) / F.when(width > 0, width)))
        ends = ends.withColumn("bins", F.when(width > 0, fd).otherwise(2).cast("int"))
    else:
        ends = ends.withColumn("bins", F.lit(max(bins, 2)))
    ends = ends.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    rows = attach(wv, ends, list(keys))
    b = _bin(F.col("x"), F.col("lo"), F.col("width"), F.col("bins"))
    hist = rows.groupBy(*keys, b.alias("bin")).agg(F.sum("n").alias("n"), F.first("lo").alias("lo"),
                                                   F.first("width").alias("width"), F.first("bins").alias("bins"))
    # each filled bin raises itself and both neighbours: the smoothed histogram, zeros left out
    near = hist.select(*keys, "bins", "n", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = near.where("bin >= 0 AND bin < bins").groupBy(*keys, "bin").agg(F.sum("n").alias("s"), F.first("bins").alias("bins"))
    near = scan(near, keys, ["bin"], {"_pb": previous("bin"), "_ps": previous("s")})
    near = scan(near, keys, ["bin"], {"_nb": previous("bin"), "_ns": previous("s")}, reverse=True)
    left = F.when(F.col("_pb") == F.col("bin") - 1, F.col("_ps")).otherwise(0)
    right = F.when(F.col("_nb") == F.col("bin") + 1, F.col("_ns")).otherwise(0)
    top = (F.col("bin") > 0) & (F.col("bin") < F.col("bins") - 1) & (F.col("s") > left) & (F.col("s") >= right)
    peaks = near.groupBy(*keys).agg(F.count_if(top).alias("peaks"))
    cut = best_cut(hist, keys, F.col("lo") + F.col("width") * (F.col("bin") + 0.5))
    out = attach(attach(ends, peaks, list(keys)), cut, list(keys))
    best = F.coalesce(F.col("cut_bin"), F.lit(0))
    reason = (
        F.when((F.col("n_rows") < 2) | (F.col("hi") - F.col("lo") <= 1e-9 * F.greatest(F.abs("hi"), F.abs("lo"))), "degenerate")
        .when((F.col("bins") > 2) & (F.col("peaks") < 2), "unimodal")
        .when(F.col("var") <= 1e-12, "degenerate_variance")
        .when((best == 0) | (best == F.col("bins") - 1), "no_separation")
        .when(F.col("between") <= 1e-12, "no_variance")
        .when(F.col("between") / (F.col("var") + 1e-12) < 0.2, "low_contrast")
    )
    tau = (F.col("lo") + F.col("width") * (best + 0.5)) * sign
    out = out.withColumn("reason", reason)
    return out.select(*keys, "n_rows", "bins", "peaks", F.when(F.col("reason").isNull(), tau).alias("tau"), "reason")


def knee_curve(
    wv: DataFrame,
    otsu: DataFrame,
    keys: Sequence[str],
    step: float = 0.05,
    k_sigma: float = 2.0,
    smooth: int = 3,
    least_points: int = 16,
) -> DataFrame:
    """Sessions left by each candidate threshold, and their moving average.

    Candidates lie on a log grid within k sigma of the Otsu threshold.
    """
    keys = list(keys)
    s = wv.groupBy(*keys).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("l")).alias("sl"),
                              F.min("l").alias("l0"), F.max("l").alias("l1"))
    mean = s.withColumn("mu", F.col("sl") / F.col("m"))
    dev = attach(wv, mean.select(*keys, "mu"), keys).groupBy(*keys).agg(
        (F.sum(F.col("n") * (F.col("l") - F.col("mu")) * (F.col("l") - F.col("mu"))) / F.sum("n")).alias("var")
    )
    p = attach(attach(mean, dev, keys), otsu.select(*keys, "tau_log"), keys)
    sigma = F.sqrt(F.greatest(F.col("var"), F.lit(1e-6)))
    a = F.greatest(F.col("l0"), F.col("tau_log") - k_sigma * sigma)
    b = F.least(F.col("l1"), F.col("tau_log") + k_sigma * sigma)
    p = p.withColumns({"a0": a, "b0": b})
    ok = F.col("b0") > F.col("a0")
    p = p.withColumns({"a": F.when(ok, F.col("a0")).otherwise(F.col("l0")), "b": F.when(ok, F.col("b0")).otherwise(F.col("l1"))})
    span = F.col("b") - F.col("a")
    want = max(2, least_points)
    stride = F.when(F.floor(span / step) + 1 < want, span / (want - 1)).otherwise(F.lit(step))
    p = p.withColumn("h", stride)
    last = F.when(span > 0, F.floor((span + 0.5 * F.col("h")) / F.col("h"))).otherwise(0).cast("int")
    grid = p.withColumn("last", last).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last"))))
    at = F.when(F.col("i") == F.col("last"), F.when(span > 0, F.col("b")).otherwise(F.col("a"))).otherwise(
        F.col("a") + F.col("i") * F.col("h")
    )
    grid = grid.select(*keys, "i", at.alias("log_threshold"))
    # a value that equals the threshold up to rounding does not exceed it
    grid = grid.withColumn("pos", F.exp("log_threshold") * (1 + 1e-12))
    marks = wv.select(*keys, F.col("x").alias("pos"), "n", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("i"),
                      F.lit(None).cast("double").alias("log_threshold"))
    both = marks.unionByName(grid.withColumns({"n": F.lit(0).cast("bigint"), "kind": F.lit(1)}))
    both = scan(both, keys, ["pos", "kind", "i"], {"upto": running_sum("n"), "all": total("n")})
    curve = both.where("kind = 1").select(
        *keys, "i", "log_threshold", F.exp("log_threshold").alias("threshold"), (F.col("all") - F.col("upto") + 1).alias("sessions")
    )
    half = smooth // 2
    if half == 0:
        return curve.withColumn("smoothed", F.col("sessions").cast("double"))
    # at most a few hundred grid points per key
    back = scan(curve, keys, ["i"], {"_b": trailing("sessions", half, inclusive=False)})
    both_sides = scan(back, keys, ["i"], {"_f": trailing("sessions", half, inclusive=False)}, reverse=True)
    near = F.concat("_b", F.array("sessions"), "_f")
    mean_of = F.aggregate(near, F.lit(0).cast("bigint"), lambda x, y: x + y) / F.size(near)
    return both_sides.withColumn("smoothed", mean_of).drop("_b", "_f")


def knee_of_curve(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Point of the curve farthest from the falling diagonal."""
    keys = list(keys)
    ends = curve.groupBy(*keys).agg(
        F.min("log_threshold").alias("_x0"), F.max("log_threshold").alias("_x1"),
        F.min("smoothed").alias("_y0"), F.max("smoothed").alias("_y1"), F.count(F.lit(1)).alias("_m"),
    )
    c = attach(curve, ends, keys)
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    x = (F.col("log_threshold") - F.col("_x0")) / F.when(dx > 0, dx)
    y = (F.col("smoothed") - F.col("_y0")) / F.when(dy > 0, dy)
    flat = ~((dx > 0) & (dy > 0))
    c = c.withColumn("_d", F.round(F.abs(x + y - 1) / SQRT2, 12))
    middle = F.when(F.col("i") == F.floor(F.col("_m") / 2), F.col("threshold"))
    best = F.max_by("threshold", F.when(F.col("_d").isNotNull(), F.struct(F.col("_d"), -F.col("i"))))
    return c.groupBy(*keys).agg(F.when(F.first(flat), F.max(middle)).otherwise(best).alias("knee"))


def sorted_knee(wv: DataFrame, keys: Sequence[str], x: str = "l") -> DataFrame:
    """Value farthest from the diagonal of the normalised sorted values.

    Columns: ``knee`` (value of x), ``distance``, n_rows, lo, hi.
    """
    keys = list(keys)
    ends = wv.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    t = attach(ranked(wv, keys, x), ends, keys)
    pos = (F.col(x) - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    steps = F.when(F.col("total") > 1, F.col("total") - 1)
    first, last = (F.col("upto") - F.col("n")) / steps, (F.col("upto") - 1) / steps
    d = F.greatest(F.abs(pos - first), F.abs(pos - last)) / SQRT2
    t = t.withColumn("_d", d)
    best = F.max_by(x, F.when(F.col("_d").isNotNull(), F.struct(F.round("_d", 12), -F.col(x))))
    return t.groupBy(*keys).agg(
        best.alias("knee"), F.max("_d").alias("distance"), F.max("total").alias("n_rows"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
    )


def knee_log(wv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Knee of ln x as a threshold in seconds; equal values give that value."""
    k = sorted_knee(wv, keys, "l")
    flat = F.col("hi") - F.col("lo") <= 1e-12
    return k.select(*keys, "n_rows", F.exp(F.when(flat, F.col("hi")).otherwise(F.col("knee"))).alias("tau"))


def detector_knee(wv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Larger of the log Otsu and the log knee."""
    o = otsu_log_even(wv, keys).select(*keys, F.col("tau").alias("_o"))
    out = attach(knee_log(wv, keys), o, list(keys))
    return out.select(*keys, "n_rows", F.greatest("tau", "_o").alias("tau"))


def loader_threshold(wv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold per user for W7: larger of right-edge Otsu and log knee."""
    o = otsu_log_even(wv, keys, "loader").select(*keys, F.col("tau").alias("_o"))
    k = sorted_knee(wv, keys, "l")
    small = (F.col("n_rows") < 3) | (F.col("hi") <= F.col("lo"))
    out = attach(k, o, list(keys))
    knee = F.exp(F.when(small, F.col("hi")).otherwise(F.col("knee")))
    return out.select(*keys, F.greatest(knee, F.col("_o")).alias("tau"))


def knee_chord(df: DataFrame, keys: Sequence[str], value: str, side: str = "upper") -> DataFrame:
    """Knee of the normalised distribution, with the reason when there is none."""
    sign = 1.0 if side == "upper" else -1.0
    src = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, (F.col(value) * sign).alias("x"))
    k = sorted_knee(weighted(src, keys, "x"), keys, "x")
    reason = (
        F.when(F.col("n_rows") < 3, "too_few_samples")
        .when(F.col("hi") - F.col("lo") <= 1e-9 * F.greatest(F.abs("hi"), F.abs("lo")), "degenerate")
        .when(F.col("distance") <= 1e-8, "flat_curve")
    )
    k = k.withColumn("reason", reason)
    return k.select(*keys, "n_rows", F.when(F.col("reason").isNull(), F.col("knee") * sign).alias("tau"), "reason")


def combined_session_threshold(
    df: DataFrame, keys: Sequence[str], value: str = "delta_seconds", min_samples: int = 5, q: float = 0.95, bimodal: bool = True
) -> DataFrame:
    """Knee, Otsu and percentile combined; percentile alone for small groups."""
    from .mixtures import bimodality

    keys = list(keys)
    wv = durable(positive(df, keys, value))
    p = durable(table_quantiles(ranked(wv, keys, "x"), keys, "x", {"p": q}, size="n_rows"))
    big = wv if min_samples <= 1 else attach(wv, p.where(F.col("n_rows") >= min_samples).select(*keys, "n_rows"), keys, "inner").drop("n_rows")
    big = big if big is wv else durable(big)
    layout = durable(log_layout(big, keys))
    otsu = durable(otsu_log(log_histogram(big, layout, keys), layout, keys))
    knee = knee_of_curve(knee_curve(big, otsu, keys), keys)
    lin = otsu_linear(big, keys).withColumnRenamed("tau", "otsu_linear")
    out = attach(attach(attach(p, otsu, keys), knee, keys), lin, keys)
    if bimodal:
        out = attach(out, bimodality(big, keys), keys)
    else:
        out = out.withColumn("bic_difference", F.lit(None).cast("double"))
    one_mode = F.coalesce(F.col("bic_difference") <= 0, F.lit(True)) | (F.col("quality") < 0.25)
    small = F.col("n_rows") < min_samples
    delta = (
        F.when(small, F.col("p"))
        .when(one_mode, F.greatest("knee", "p"))
        .otherwise(F.greatest("otsu_linear", "knee", "p"))
    )
    return out.select(
        *keys,
        "n_rows",
        F.when(small, 0).otherwise(F.col("fd_bins")).alias("fd_bins"),
        F.when(~small, F.col("tau_log")).alias("tau_otsu"),
        F.when(~small & (F.col("knee") > 0), F.ln("knee")).alias("tau_knee"),
        F.ln(F.greatest(delta, F.lit(TINY))).alias("tau_final"),
        delta.alias("delta_t"),
        F.when(~small, F.col("bic_difference")).alias("bimodality_test"),
    )


def backoff_thresholds(
    df: DataFrame,
    user: str = "uid",
    group: str | Column | None = "op_category",
    value: str = "delta_seconds",
    min_events: int = 50,
    label: str | None = None,
    index: str = "row_index",
    estimator=combined_session_threshold,
    **options,
) -> DataFrame:
    """Thresholds of the user, else of its group, else of everyone.

    ``group`` (X2) is a column name, a Column or None; blank values become
    ``unknown``.  A user belongs to the group of its first row.  Users without
    positive gaps are kept.
    """
    name = label or (group if isinstance(group, str) else "backoff")
    col = F.col(group) if isinstance(group, str) else group
    rows = df.withColumn("_g", F.coalesce(F.nullif(F.trim(col.cast("string")), F.lit("")), F.lit("unknown"))) if group is not None else df
    keys = [user] + (["_g"] if group is not None else [])
    levels = {"user": [user], "global": []} | ({"group": ["_g"]} if group is not None else {})
    base = tiers(rows.select(*keys, value), keys, levels)
    t = durable(estimator(base, ["level", *keys], value, **options))
    cols = [c for c in t.columns if c not in ("level", *keys)]
    pack = F.struct(*cols)

    def of(level, on):
        return t.where(F.col("level") == level).select(*on, pack.alias(f"_{level}"))

    users = rows.groupBy(user).agg(*([F.min_by("_g", index).alias("_g")] if group is not None else []))
    out = attach(join_on(users, of("user", [user]), [user]), of("global", []), [])
    enough = {p: F.coalesce(F.col(f"_{p}.n_rows"), F.lit(0)) for p in levels if p != "group"}
    pick = F.when(enough["user"] >= min_events, "user")
    if group is not None:
        out = join_on(out, of("group", ["_g"]), ["_g"])
        g = F.coalesce(F.col("_group.n_rows"), F.lit(0))
        pick = pick.when(g >= min_events, "group").when(enough["global"] >= min_events, "global").when(g > 0, "group")
    pick = pick.when(enough["global"] > 0, "global").otherwise("user")
    out = out.withColumn("_pick", pick)
    chosen = F.when(F.col("_pick") == "user", F.col("_user")).when(F.col("_pick") == "global", F.col("_global"))
    if group is not None:
        chosen = chosen.when(F.col("_pick") == "group", F.col("_group"))
    out = out.withColumn("_c", chosen)
    shown = F.col("_pick")
    if group is not None:
        shown = F.when(F.col("_pick") == "group", F.concat(F.lit(f"group:{name}="), F.col("_g"))).otherwise(shown)
    return out.select(user, shown.alias("backoff_level"), *[F.col(f"_c.{c}").alias(c) for c in cols])


def pick_hierarchical(df: DataFrame, sources: Sequence[str] = ("user", "group", "global"), min_events: int = 50) -> Column:
    """First source with enough events, else the first present; knee if flagged.

    Each source is a struct column ``(event_count, tau_otsu, tau_knee, use_knee)``.
    """
    tau = [F.when(F.col(f"{s}.use_knee") & F.col(f"{s}.tau_knee").isNotNull(), F.col(f"{s}.tau_knee")).otherwise(F.col(f"{s}.tau_otsu")) for s in sources]
    enough = [F.when(F.col(f"{s}.event_count") >= min_events, t) for s, t in zip(sources, tau, strict=True)]
    present = [F.when(F.col(s).isNotNull(), t) for s, t in zip(sources, tau, strict=True)]
    return F.exp(F.coalesce(*enough, *present))


def quantile_threshold(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.005, side: str = "both") -> DataFrame:
    """Upper and lower quantile as thresholds."""
    q = quantiles(df, keys, value, {"tau_hi": 1 - alpha, "tau_lo": alpha}, size="n")
    none = F.lit(None).cast("double")
    return q.select(
        *keys, "n",
        (F.col("tau_hi") if side in ("upper", "both") else none).alias("tau_hi"),
        (F.col("tau_lo") if side in ("lower", "both") else none).alias("tau_lo"),
    )


def tail_by_moments(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.99) -> DataFrame:
    """Peaks over the q-quantile with a moment fit, in two aggregations."""
    keys = list(keys)
    u = quantiles(df, keys, value, {"u": q}, size="n")
    over = attach(df.where(F.col(value).isNotNull()).select(*keys, value), u, keys).where(F.col(value) > F.col("u"))
    y = F.col(value) - F.col("u")
    m = over.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_exc"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v"))
    out = attach(u, m, keys).withColumn("n_exc", F.coalesce("n_exc", F.lit(0)))
    fit = (F.col("n_exc") >= 2) & (F.col("_v") > 0)
    bounded = F.greatest(F.lit(-0.9), F.least(F.lit(0.95), 0.5 * (1 - F.col("_m") * F.col("_m") / F.col("_v"))))
    out = out.withColumn("xi", F.when(fit, bounded).otherwise(0.0))
    beta = (
        F.when(F.col("n_exc") == 0, 1e-6)
        .when(fit, F.greatest(F.col("_m") * (1 - F.col("xi")), F.lit(1e-9)))
        .when(F.col("n_exc") == 1, F.greatest(F.col("_m"), F.lit(1e-6)))
        .otherwise(F.greatest(F.col("_m"), F.lit(1e-9)))
    )
    out = out.withColumns({"beta": beta, "p_ref": F.col("n_exc") / F.col("n")})
    target = max(1 - q, 1e-6)
    p = F.col("p_ref")
    q_star = F.greatest(F.least(F.lit(target), F.when(p > 0, p).otherwise(target)), F.lit(1e-6))
    out = out.withColumn("q_star", q_star)
    level = tail_threshold(F.col("u"), F.col("xi"), F.col("beta"), p, F.col("q_star"), limit=1e-6)
    tau = F.when(p > 0, F.greatest(level, F.col("u"))).otherwise(F.col("u"))
    return out.withColumn("tau", tau).drop("_m", "_v")


def mean_plus_sigma(df: DataFrame, keys: Sequence[str], score: str, k: float = 3.0) -> DataFrame:
    """Mean + k standard deviations of the scores of normal rows."""
    return df.groupBy(*keys).agg(F.count(score).alias("n"), (F.avg(score) + k * F.stddev_pop(score)).alias("tau"))


# resolvers --------------------------------------------------------------------


def estimate(df: DataFrame, keys: Sequence[str], value: str, method: str, alpha: float = 0.005, side: str = "both", **options) -> DataFrame:
    """One estimator as (keys, n, tau_hi, tau_lo, reason)."""
    keys = list(keys)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if method == "quantile":
        return quantile_threshold(df, keys, value, alpha, side).withColumn("reason", text)
    if method == "spot":
        from .tailfit import spot_threshold

        return spot_threshold(df, keys, value, side=side, **options)
    fn = {"otsu": otsu_gated, "knee": knee_chord}[method]
    size = df.groupBy(*keys).agg(F.count(value).alias("n"))
    out = size
    for s, name in (("upper", "tau_hi"), ("lower", "tau_lo")):
        if side in (s, "both"):
            one = fn(df, keys, value, side=s).select(*keys, F.col("tau").alias(name), F.col("reason").alias(f"_r_{s}"))
            out = attach(out, one, keys)
        else:
            out = out.withColumn(name, none).withColumn(f"_r_{s}", text)
    return out.select(*keys, "n", "tau_hi", "tau_lo", F.coalesce("_r_upper", "_r_lower").alias("reason"))


def resolve_method(
    df: DataFrame, keys: Sequence[str], value: str, method: str, fallbacks: Sequence[str] = (), n_min: int = 200,
    allow_small: Column | bool = False, **options,
) -> DataFrame:
    """First method of the chain that gives a threshold.

    ``status`` is ok, skipped or backoff (too few values); ``reason`` tells why
    earlier methods failed.
    """
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count(value).alias("n"))
    chain = [method, *fallbacks]
    out = size
    for i, m in enumerate(chain):
        e = estimate(df, keys, value, m, **options)
        out = attach(out, e.select(*keys, F.struct("tau_hi", "tau_lo", "reason").alias(f"_e{i}")), keys)
    works = [F.col(f"_e{i}.tau_hi").isNotNull() | F.col(f"_e{i}.tau_lo").isNotNull() for i in range(len(chain))]
    pick = F.coalesce(*[F.when(w, i) for i, w in enumerate(works)])
    small = F.lit(allow_small) if isinstance(allow_small, bool) else allow_small
    status = F.when(F.col("n") == 0, "skipped").when(~small & (F.col("n") < n_min), "backoff").when(pick.isNull(), "skipped").otherwise("ok")
    out = out.withColumn("_p", pick).withColumn("status", status)
    usable = F.col("status") == "ok"

    def of(field):
        return F.coalesce(*[F.when(F.col("_p") == i, F.col(f"_e{i}.{field}")) for i in range(len(chain))])

    last = F.col(f"_e{len(chain) - 1}.reason")
    reason = (
        F.when(F.col("n") == 0, "no_finite_samples")
        .when(F.col("status") == "backoff", "insufficient_samples")
        .when(F.col("status") == "skipped", F.coalesce(last, F.lit(f"{chain[-1]}_failed")))
        .otherwise(of("reason"))
    )
    applied = F.coalesce(*[F.when(F.col("_p") == i, m) for i, m in enumerate(chain)], F.lit(chain[-1]))
    return out.select(
        *keys, "n", F.when(usable, of("tau_hi")).alias("tau_hi"), F.when(usable, of("tau_lo")).alias("tau_lo"),
        F.when(F.col("status") == "backoff", F.lit(method)).otherwise(applied).alias("applied_method"), "status", reason.alias("reason"),
    )


def resolve_hierarchy(
    df: DataFrame, keys: Sequence[str], value: str, method: str = "quantile", fallbacks: Sequence[str] = (), n_min: int = 200, **options
) -> DataFrame:
    """Each full key takes the first level (key prefix down to all rows) that works."""
    keys = list(keys)
    levels = {f"l{i}": keys[:i] for i in range(len(keys), -1, -1)}
    rows = tiers(df.select(*keys, value), keys, levels)
    t = durable(resolve_method(rows, ["level", *keys], value, method, fallbacks, n_min, allow_small=F.col("level") == "l0", **options))
    cols = ["n", "tau_hi", "tau_lo", "applied_method", "status", "reason"]
    pack = F.struct(*cols)
    out = df.select(*keys).distinct()
    for name, own in levels.items():
        part = t.where(F.col("level") == name).select(*own, pack.alias(f"_{name}"))
        out = attach(out, part, own)
    usable = [(name, (F.col(f"_{name}.status") == "ok") | F.lit(name == "l0")) for name in levels]
    chosen = F.coalesce(*[F.when(ok, F.col(f"_{name}")) for name, ok in usable])
    level = F.coalesce(*[F.when(ok, F.lit("::".join(levels[name]) or "global")) for name, ok in usable])
    out = out.withColumn("_c", chosen).withColumn("group_level", level)
    full = "::".join(keys)
    back = F.when(F.col("group_level") != full, F.concat(F.lit("backoff_to_"), F.regexp_replace("group_level", "::", "_")))
    return out.select(
        *keys, "group_level", *[F.col(f"_c.{c}").alias(c) for c in cols if c != "reason"],
        F.coalesce(F.col("_c.reason"), back).alias("reason"),
    )


def same_kind_gaps(df: DataFrame, user: str = "uid", category: str = "op_category", epoch: str = "epoch_s", index: str = "row_index") -> DataFrame:
    """Gap to the previous row in input order, and whether user and category stay the same."""
    out = scan(df, [], [index], {"_pt": previous(epoch), "_pu": previous(user), "_pc": previous(category)})
    raw = F.col(epoch) - F.col("_pt")
    gap = F.when(raw >= 0, F.greatest(raw, F.lit(1e-6)))
    out = out.withColumns({"has_gap": gap.isNotNull(), "observed_s": F.coalesce(gap, F.lit(0.0))})
    same = (F.col(user) == F.col("_pu")) & (F.col(category) == F.col("_pc"))
    return out.withColumn("boundary", ~F.coalesce(same, F.lit(False))).drop("_pt", "_pu", "_pc")


def detector_threshold(df: DataFrame, keys: Sequence[str], value: str, method: str, upper: float = 0.99, lower: float = 0.01, fixed: float | None = None) -> DataFrame:
    """One detector method as (keys, n, tau_hi, tau_lo)."""
    keys = list(keys)
    base = quantiles(df, keys, value, {"_hi": upper, "tau_lo": lower}, size="n")
    if method == "quantile":
        return base.select(*keys, "n", F.col("_hi").alias("tau_hi"), "tau_lo")
    if method == "fixed":
        return base.select(*keys, "n", F.lit(fixed).cast("double").alias("tau_hi"), "tau_lo")
    if method == "spot":
        t = tail_by_moments(df, keys, value, upper).select(*keys, F.col("tau").alias("tau_hi"))
    else:
        wv = positive(df, keys, value)
        t = (otsu_log_even(wv, keys) if method == "otsu" else detector_knee(wv, keys)).select(*keys, F.col("tau").alias("tau_hi"))
    return attach(base.select(*keys, "n", "tau_lo"), t, keys).select(*keys, "n", "tau_hi", "tau_lo")


def detector_thresholds(
    pairs: DataFrame, method: str = "quantile", user: str = "uid", category: str = "op_category", value: str = "observed_s",
    min_samples: int = 5, **options,
) -> DataFrame:
    """Thresholds per (user, category) from same-kind gaps, global ones for small groups.

    The last row (NULL keys) is the global threshold from all gaps.
    """
    gaps = pairs.where(~F.col("boundary") & F.col("has_gap"))
    glob = detector_threshold(pairs.where(F.col("has_gap")), [], value, method, **options)
    g = detector_threshold(gaps, [user, category], value, method, **options)
    g = attach(g, glob.select(F.col("tau_hi").alias("_ghi"), F.col("tau_lo").alias("_glo")), [])
    own = (F.col("n") >= min_samples) & F.col("tau_hi").isNotNull()
    hi = F.greatest(F.when(own, F.col("tau_hi")).otherwise(F.col("_ghi")), F.lit(0.0))
    lo = F.coalesce(F.when(F.col("n") >= min_samples, F.col("tau_lo")), F.col("_glo"))
    g = g.select(user, category, "n", hi.alias("tau_hi"), F.greatest(F.least(lo, hi), F.lit(0.0)).alias("tau_lo"), (~own).alias("fallback"))
    hi = F.greatest(F.col("tau_hi"), F.lit(0.0))
    low = F.greatest(F.least(F.col("tau_lo"), hi), F.lit(0.0))
    rest = glob.select("n", hi.alias("tau_hi"), low.alias("tau_lo"), F.lit(True).alias("fallback"))
    return g.unionByName(rest, allowMissingColumns=True)


def score_pairs(pairs: DataFrame, thresholds: DataFrame, user: str = "uid", category: str = "op_category") -> DataFrame:
    """Distance beyond the group's thresholds; boundary rows are never flagged."""
    own = thresholds.where(F.col(user).isNotNull()).select(user, category, F.col("tau_hi").alias("_h"), F.col("tau_lo").alias("_l"))
    glob = thresholds.where(F.col(user).isNull()).select(F.col("tau_hi").alias("_gh"), F.col("tau_lo").alias("_gl"))
    out = attach(join_on(pairs, own, [user, category]), glob, [])
    out = out.withColumns({"tau_hi": F.coalesce("_h", "_gh"), "tau_lo": F.coalesce("_l", "_gl")})
    x, hi, lo = F.col("observed_s"), F.col("tau_hi"), F.col("tau_lo")
    above, below = ~F.col("boundary") & (x > hi), ~F.col("boundary") & (x < lo)
    return out.withColumns(
        {
            "score": F.when(above, x - hi).when(below, lo - x).otherwise(0.0),
            "s_q": F.when(above, x / F.greatest(hi, F.lit(1e-9)))
            .when(below, F.greatest(lo, F.lit(1e-9)) / F.greatest(x, F.lit(1e-9)))
            .otherwise(1.0),
            "flag": above | below,
        }
    ).drop("_h", "_l", "_gh", "_gl")
