"""Aggregates over gaps and events (A1-A3, A8-A11, A17-A19) and tier lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import attach, durable, join_on, previous, quantiles, running_sum, scan, tiers

ALL, EVERYONE = "__all__", "__global__"


def measurement_floor(df: DataFrame, keys: Sequence[str] = (), value: str = "delta_seconds") -> DataFrame:
    """A1: half the smallest positive gap, limited to 1e-6 .. 1e-2."""
    low = F.min(F.when(F.col(value) > 0, F.col(value)))
    eps = F.greatest(F.lit(1e-6), F.least(F.lit(1e-2), 0.5 * low))
    return df.groupBy(*keys).agg(F.when(low.isNull(), 1e-6).otherwise(eps).alias("epsilon"))


def quantile_floor(df: DataFrame, value: str = "delta_seconds", q: float = 0.05) -> DataFrame:
    """A2: half the 5th percentile of positive gaps, limited to 1e-6 .. 1e-2."""
    p = quantiles(df.where(F.col(value) > 0), [], value, {"p": q})
    eps = F.greatest(F.lit(1e-6), F.least(F.lit(1e-2), 0.5 * F.col("p")))
    return p.select(F.when(F.col("p").isNull(), 1e-6).otherwise(eps).alias("epsilon"))


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Size, mean, squared deviations, both standard deviations, extremes."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.stddev_pop(value).alias("std_pop"),
        F.stddev_samp(value).alias("std_samp"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def merge_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine partial (n, mean, m2, lowest, highest) rows.

    Deviations of the part means are taken from the combined mean, found first:
    a difference of large squares would cancel.  Parts are few: one row per task or file.
    """
    n = F.sum("n")
    means = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / n).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    return attach(parts, means, keys, "inner").groupBy(*keys).agg(
        n.alias("n"), F.first("_mean").alias("mean"),
        (F.sum("m2") + F.sum(F.col("n") * off * off)).alias("m2"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
    )


def quantile_table(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], rule: str = "simple") -> DataFrame:
    """One row per key and level; rule ``simple`` or ``r7``."""
    names = {f"q{i}": p for i, p in enumerate(levels)}
    wide = quantiles(df, keys, value, names, rule, size="n")
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(c).alias("value")) for c, p in names.items()])
    return wide.select(*keys, "n", F.explode(pairs).alias("_q")).select(*keys, "n", "_q.*")


def tier_levels(user: str, category: str) -> dict[str, list[str]]:
    return {"group": [user, category], "user": [user], "global": []}


def _named(tables: DataFrame, user: str, category: str) -> DataFrame:
    return tables.withColumns(
        {
            category: F.when(F.col("level") == "group", F.col(category)).when(F.col("level") == "user", ALL).otherwise(EVERYONE),
            user: F.when(F.col("level") == "global", EVERYONE).otherwise(F.col(user)),
        }
    )


def resolve_tiers(stats: DataFrame, user: str, category: str, min_samples: int, need_user: bool) -> DataFrame:
    """For each group the statistics of group, user or all, plus user and global rows.

    ``stats`` has ``level`` (group, user, global), the keys, ``n`` and further
    columns.  A user row counts with ``min_samples`` only if ``need_user``.
    """
    cols = [c for c in stats.columns if c not in ("level", user, category)]
    pack = F.struct(*cols)

    def of(level, keys):
        return stats.where(F.col("level") == level).select(*keys, pack.alias(f"_{level}"))

    groups = join_on(of("group", [user, category]), of("user", [user]), [user])
    groups = attach(groups, of("global", []), [])
    enough_user = F.col("_user.n") >= min_samples if need_user else F.col("_user").isNotNull()
    tier = (
        F.when(F.col("_group.n") >= min_samples, "group").when(enough_user, "user").otherwise("global")
    )
    chosen = (
        F.when(F.col("tier") == "group", F.col("_group"))
        .when(F.col("tier") == "user", F.col("_user"))
        .otherwise(F.col("_global"))
    )
    groups = groups.withColumn("tier", tier).withColumn("_c", chosen)
    out = groups.select(
        user,
        category,
        "tier",
        F.when(F.col("tier") == "global", EVERYONE).otherwise(F.col(user)).alias("source_uid"),
        F.when(F.col("tier") == "group", F.col(category))
        .when(F.col("tier") == "user", ALL)
        .otherwise(EVERYONE)
        .alias("source_op_category"),
        *[F.col(f"_c.{c}").alias(c) for c in cols],
    )
    rest = _named(stats.where(F.col("level") != "group"), user, category).withColumnRenamed("level", "tier")
    rest = rest.withColumn("source_uid", F.col(user)).withColumn("source_op_category", F.col(category))
    return out.unionByName(rest.select(out.columns))


def quantile_tiers(
    df: DataFrame,
    value: str,
    user: str = "uid",
    category: str = "op_category",
    min_samples: int = 30,
    upper: float = 0.99,
    lower: float = 0.01,
    levels: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9),
) -> DataFrame:
    """A10: thresholds and quantile points per (user, category) with fallback tiers."""
    ps = sorted({*levels, upper, lower})
    names = {f"q{i}": p for i, p in enumerate(ps)}
    rows = tiers(df.select(user, category, value), [user, category], tier_levels(user, category))
    q = quantiles(rows, ["level", user, category], value, names, "simple", size="n")
    cdf = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(c).alias("value")) for c, p in names.items()])
    by_p = {p: c for c, p in names.items()}
    stats = q.select(
        "level", user, category, "n",
        F.col(by_p[upper]).alias("tau_hi"), F.col(by_p[lower]).alias("tau_lo"), cdf.alias("cdf"),
    )
    return resolve_tiers(durable(stats), user, category, min_samples, need_user=True)  # read once per level


def alarm_budget(thresholds: DataFrame, budget: float = 1e-2, weight: str = "count") -> DataFrame:
    """The alarm budget shared by row count or evenly."""
    w = F.greatest(F.col("n"), F.lit(0)).cast("double") if weight == "count" else F.lit(1.0)
    rows = thresholds.withColumn("weight", w)
    sums = rows.agg(F.sum("weight").alias("_sw"), F.count(F.lit(1)).alias("_k"))
    rows = attach(rows, sums, [])
    even = F.col("_sw") <= 0
    rows = rows.withColumn("weight", F.when(even, 1.0).otherwise(F.col("weight")))
    share = F.col("weight") / F.when(even, F.col("_k")).otherwise(F.col("_sw"))
    return rows.withColumn("q_alloc", share * budget).drop("_sw", "_k")


def lookup(rows: DataFrame, table: DataFrame, columns: Sequence[str], user: str = "uid", category: str = "op_category") -> DataFrame:
    """Statistics of the exact key, else of the user, else of everyone.

    Whether a side is broadcast is left to the size-checked join choice.
    """
    pack = F.struct(*columns)
    exact = table.where(~F.col(category).isin(ALL, EVERYONE)).select(user, category, pack.alias("_x"))
    users = table.where(F.col(category) == ALL).select(user, pack.alias("_u"))
    every = table.where(F.col(user) == EVERYONE).select(pack.alias("_g"))
    out = join_on(join_on(rows, exact, [user, category]), users, [user])
    out = attach(out, every, []).withColumn("_c", F.coalesce("_x", "_u", "_g"))
    out = out.withColumn(
        "lookup_level",
        F.when(F.col("_x").isNotNull(), "group").when(F.col("_u").isNotNull(), "user").otherwise("global"),
    )
    return out.select("*", *[F.col(f"_c.{c}").alias(c) for c in columns]).drop("_x", "_u", "_g", "_c")


# vocabulary and transitions -------------------------------------------------

RESERVED = ["<pad>", "<unk>", "<bos>"]


def vocabulary(df: DataFrame, token: str, reserved: Sequence[str] = RESERVED, min_freq: int = 1) -> DataFrame:
    """Token ids by falling count, then token, after the reserved ids.

    The distinct tokens are ranked by a scan, so a large vocabulary is not
    ordered in one task.
    """
    counts = df.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("freq"))
    counts = counts.where((F.col("freq") >= min_freq) & ~F.col("token").isin(list(reserved)))

    ids = scan(counts.withColumn("_o", -F.col("freq")), [], ["_o", "token"], {"_n": running_sum(F.lit(1))})
    ids = ids.select("token", (F.col("_n") + len(reserved) - 1).cast("int").alias("id"), "freq")
    fixed = df.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in enumerate(reserved)], "token string, id int, freq bigint"
    )
    return fixed.unionByName(ids)


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], token: str, context: int = 1) -> DataFrame:
    """Counts and probabilities of the next token after ``context`` tokens."""
    rows = scan(df, keys, order, {"_p1": previous(token)})
    names = ["_p1"]
    for i in range(2, context + 1):
        rows = scan(rows, keys, order, {f"_p{i}": previous(f"_p{i - 1}")})
        names.append(f"_p{i}")
    full = rows.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in names)))
    ctx = F.concat_ws(" ", *[F.col(c) for c in reversed(names)])
    counts = full.groupBy(ctx.alias("context"), F.col(token).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("context").agg(F.sum("n").alias("context_n"))
    return join_on(counts, total, ["context"]).withColumn("p", F.col("n") / F.col("context_n"))


def next_token_probability(trans: DataFrame, pairs: DataFrame, vocabulary_size: Column, normalize: bool = False) -> DataFrame:
    """Probability of each (context, target): count share, else 1/V.

    Unseen targets of a seen context keep 1/V without rescaling, unless
    ``normalize`` divides by the resulting mass.
    """
    seen = trans.groupBy("context").agg(F.count(F.lit(1)).alias("_kinds"))
    out = join_on(pairs, trans.select("context", "target", "p"), ["context", "target"])
    out = join_on(out, seen, ["context"])
    p = F.coalesce(F.col("p"), 1 / vocabulary_size)
    if normalize:
        extra = (vocabulary_size - F.col("_kinds")) / vocabulary_size
        p = p / F.when(F.col("_kinds").isNull(), 1.0).otherwise(1 + extra)
    return out.withColumn("p", p).drop("_kinds")


def rate_table(df: DataFrame, keys: Sequence[str], value: str = "delta_seconds", eps: float = 1e-6) -> DataFrame:
    """Log base rate ln(1/mean gap), decay and scale per key."""
    mean = F.coalesce(F.avg(value), F.lit(1.0))
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), mean.alias("_m"), F.stddev_samp(value).alias("_s"))
    std = F.when(F.col("n") > 1, F.col("_s")).otherwise(F.col("_m"))
    rate = 1 / F.greatest(F.col("_m"), F.lit(eps))
    wide = F.when(std > eps, std).otherwise(F.col("_m"))
    return base.select(
        *keys, "n",
        F.ln(F.greatest(rate, F.lit(eps))).alias("g"),
        (-1 / F.greatest(wide, F.lit(eps))).alias("decay"),
        F.greatest(std, F.lit(eps)).alias("scale"),
    )


def model_sizes(vocab_size: Column, events: Column) -> dict[str, Column]:
    """Embedding and hidden width, dropout from vocabulary and data size."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(vocab_size, F.lit(2)))))
    emb = F.least(F.lit(256), F.greatest(F.lit(32), power.cast("int")))
    drop = F.when(events >= 100_000, 0.3).when(events >= 50_000, 0.25).when(events >= 10_000, 0.2).otherwise(0.1)
    return {
        "embedding_dim": emb,
        "hidden_size": F.least(F.lit(512), F.greatest(F.lit(64), emb * 2)),
        "dropout": drop,
    }


