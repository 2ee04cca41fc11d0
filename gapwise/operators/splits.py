"""Time-ordered splits of sessions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha1, unit_rank
from ..scale import attach, join_on, quantiles, running_max, running_sum, scan
from .joins import session_order


def seeded_tie(seed: int, session: str = "session_id") -> Column:
    """G1: reproducible shuffle key for sessions that start together."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(session)))


def ordered_sessions(sessions: DataFrame, seed: int | None = None) -> DataFrame:
    """G1: sessions with ``rank`` and ``total``; ties by seeded hash, else by id."""
    ties = [seeded_tie(seed), "session_id"] if seed is not None else ["session_id"]
    out = session_order(sessions, "start_s", ties)
    n = sessions.agg(F.count(F.lit(1)).alias("total"))
    return attach(out, n, [])


def rolling_origin(
    ranked: DataFrame, train: int, val: int, test: int = 0, step: int = 1, purge: int = 0, embargo: int = 0, max_folds: int | None = None
) -> DataFrame:
    """(fold, session, role) with a growing training part.

    Fold k trains on the first train + k*step sessions less the last ``embargo``,
    and evaluates after a gap of ``purge`` sessions.  Folds that would run past
    the end do not exist.
    """
    need = train + purge + val + test
    folds = F.floor((F.col("total") - need) / step) + 1
    if max_folds is not None:
        folds = F.least(folds, F.lit(max_folds))
    if train - embargo <= 0:
        folds = F.lit(0)
    rows = ranked.withColumn("_k", folds.cast("int")).where("_k > 0")
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    r, end = F.col("rank"), F.lit(train) + F.col("fold") * step
    v0, v1, t1 = end + purge, end + purge + val, end + purge + val + test
    role = F.when(r < end - embargo, "train").when((r >= v0) & (r < v1), "validation").when((r >= v1) & (r < t1), "test")
    return rows.withColumn("role", role).where("role IS NOT NULL").drop("_k")


def auto_embargo(sessions: DataFrame, gaps: DataFrame, gap: str = "gap_s") -> DataFrame:
    """Longer of the longest session and twice the median gap."""
    long = sessions.agg(F.max("duration").alias("longest"))
    med = quantiles(gaps.where(F.col(gap) >= 0), [], gap, {"median": 0.5})
    both = attach(long, med, [])
    return both.select(F.greatest(F.coalesce("longest", F.lit(0.0)), 2 * F.coalesce("median", F.lit(0.0))).alias("embargo_s"))


def rolling_purged(
    ranked: DataFrame, folds: int, horizon: int, embargo_s: float | DataFrame, rolling: str = "expanding", window: int = 0, group: str = "group"
) -> DataFrame:
    """Train, dev and test per fold; training sessions that end after the dev start,
    share a group with dev or test, or start inside the embargo are purged.
    """
    span = 2 * horizon
    rows = ranked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    initial = F.lit(window) if window > 0 else F.col("total") - folds * span
    end = initial + F.col("fold") * span
    start = F.greatest(F.lit(0), end - window) if rolling == "fixed" else F.lit(0)
    r = F.col("rank")
    role = F.when((r >= start) & (r < end), "train").when((r >= end) & (r < end + horizon), "dev").when(
        (r >= end + horizon) & (r < end + span), "test"
    )
    rows = rows.withColumn("role", role).where("role IS NOT NULL")
    ev = rows.where("role <> 'train'")
    bounds = ev.groupBy("fold").agg(
        F.min(F.when(F.col("role") == "dev", F.col("start_s"))).alias("_dev0"),
        F.max(F.when(F.col("role") == "test", F.col("end_s"))).alias("_test1"),
    )
    out = join_on(rows, F.broadcast(bounds), ["fold"])  # one row per fold
    if isinstance(embargo_s, DataFrame):
        out = attach(out, embargo_s.select(F.col(embargo_s.columns[0]).alias("_emb")), [])
    else:
        out = out.withColumn("_emb", F.lit(float(embargo_s)))
    used = ev.select("fold", group).distinct().withColumn("_used", F.lit(True))
    out = join_on(out, used, ["fold", group])
    fenced = (F.col("start_s") >= F.col("_test1")) & (F.col("start_s") < F.col("_test1") + F.col("_emb"))
    bad = (F.col("end_s") > F.col("_dev0")) | F.col("_used").isNotNull() | fenced
    keep = (F.col("role") != "train") | ~F.coalesce(bad, F.lit(False))
    return out.where(keep).drop("_dev0", "_test1", "_emb", "_used")


def group_rank(group: Column, seed: int) -> Column:
    """Stable rank of a group in [0, 1)."""
    return unit_rank(hmac_sha1(str(seed).encode(), group.cast("string")))


def group_holdout(ranked: DataFrame, val_fraction: float, seed: int, group: str = "group") -> DataFrame:
    """Hold out groups seen among the latest sessions; train on what ended before.

    Groups of the last part with a rank below the fraction are held out, the
    lowest-ranked one if there is none.  The highest-ranked ones are given back
    until some session can be trained on; which prefix of the rank order that
    leaves follows from running minima, without trying one by one.
    """
    tail = F.col("rank") >= F.col("total") - F.greatest(F.lit(1), F.ceil(F.col("total") * max(val_fraction, 0.1)))
    g = ranked.groupBy(group).agg(
        F.max(tail.cast("int")).alias("_late"), F.min("start_s").alias("_start"), F.min("end_s").alias("_end")
    ).withColumn("_r", group_rank(F.col(group), seed))
    low = g.where("_late = 1").agg(F.min(F.struct("_r", group)).alias("_lowest"), F.count_if(F.col("_r") < val_fraction).alias("_hits"))
    g = attach(g, low, [])
    lowest = (F.col("_hits") == 0) & (F.col("_r") == F.col("_lowest._r")) & (F.col(group) == F.col(f"_lowest.{group}"))
    held = (F.col("_late") == 1) & ((F.col("_r") < val_fraction) | lowest)
    g = g.withColumn("_held", held).drop("_lowest", "_hits")
    rest = g.where("NOT _held").agg(F.min("_end").alias("_rest"))
    v = scan(g.where("_held"), [], ["_r", group], {"_cut": running_max(-F.col("_start")), "_pos": running_sum(F.lit(1))})
    v = scan(v, [], ["_r", group], {"_later": running_max(-F.col("_end"), inclusive=False)}, reverse=True)
    v = attach(v, rest, [])
    first_end = F.least(-F.col("_later"), F.col("_rest"))  # least skips NULL
    v = v.withColumns({"cutoff_s": -F.col("_cut"), "_ok": first_end <= -F.col("_cut")})
    take = v.where("_ok").agg(F.max(F.struct("_pos", "cutoff_s")).alias("_t"))
    v = attach(v.select(group, "_pos"), take, []).where(F.col("_pos") <= F.col("_t._pos")).select(group, F.lit(True).alias("_val"))
    out = attach(join_on(ranked, v, [group]), take.select(F.col("_t.cutoff_s").alias("_cutoff")), [])
    role = F.when(F.col("_val"), "val").when(F.col("end_s") <= F.col("_cutoff"), "train")
    return out.withColumn("role", role).where("role IS NOT NULL").drop("_val", "_cutoff")


def late_holdout(ranked: DataFrame, val_fraction: float) -> DataFrame:
    """G5 without groups: the last sessions; train on sessions that ended before,
    on all other sessions if none did."""
    first = F.col("total") - F.greatest(F.lit(1), F.ceil(F.col("total") * val_fraction))
    val = F.col("rank") >= first
    cut = ranked.where(val).agg(F.min("start_s").alias("_cutoff"))
    out = attach(ranked, cut, [])
    early = out.where(~val).agg(F.coalesce(F.min("end_s") <= F.first("_cutoff"), F.lit(False)).alias("_early"))
    out = attach(out, early, [])
    role = F.when(val, "val").when((F.col("end_s") <= F.col("_cutoff")) | ~F.col("_early"), "train")
    return out.withColumn("role", role).where("role IS NOT NULL").drop("_cutoff", "_early")


def partition_sizes(n: int) -> tuple[int, int, int]:
    """70/10/20 by largest remainder; small tables still fill validation, then test."""
    if n <= 0:
        return 0, 0, 0
    exact = [n * share for share in (0.7, 0.1, 0.2)]
    sizes = [math.floor(x) for x in exact]
    by_rest = sorted(range(3), key=lambda i: (-(exact[i] - sizes[i]), i))
    for i in by_rest[: n - sum(sizes)]:
        sizes[i] += 1
    if sizes[0] == 0:
        donor = 2 if sizes[2] else 1
        sizes[0], sizes[donor] = 1, sizes[donor] - 1
    if n >= 3 and sizes[1] == 0 and sizes[2] > 0:
        sizes[1], sizes[2] = 1, sizes[2] - 1
    if n >= 5 and sizes[2] == 0:
        donor = 1 if sizes[1] > 1 else 0
        sizes[donor], sizes[2] = sizes[donor] - 1, 1
    return sizes[0], sizes[1], sizes[2]


def chronological(ranked: DataFrame) -> DataFrame:
    """First 70 % train, next 10 % validation, last 20 % test."""
    head = ranked.select("total").first()
    a, b, _ = partition_sizes(head["total"] if head else 0)
    r = F.col("rank")
    return ranked.withColumn("role", F.when(r < a, "train").when(r < a + b, "validation").otherwise("test"))


def split_violations(assignment: DataFrame, embargo_s: float, group: str = "group", evals: Sequence[str] = ("validation", "dev", "val", "test")) -> DataFrame:
    """Broken rules per fold: time order, shared sessions, shared groups, embargo."""
    a = assignment if "fold" in assignment.columns else assignment.withColumn("fold", F.lit(0))
    ev = a.where(F.col("role").isin(list(evals)))
    bounds = ev.groupBy("fold", "role").agg(F.min("start_s").alias("_s"), F.max("end_s").alias("_e"))
    tr = a.where("role = 'train'").select("fold", "session_id", group, F.col("start_s").alias("t0"), F.col("end_s").alias("t1"))
    # one row per fold and evaluation role
    per = tr.join(F.broadcast(bounds), "fold")
    late = per.groupBy("fold", "role").agg(
        F.count_if(F.col("t1") > F.col("_s")).alias("ends_after_start"),
        F.count_if((F.col("t0") >= F.col("_e")) & (F.col("t0") < F.col("_e") + embargo_s)).alias("inside_embargo"),
    )
    shared = ev.select("fold", "role", "session_id").distinct().join(tr.select("fold", "session_id").distinct(), ["fold", "session_id"])
    groups = ev.select("fold", "role", group).distinct().join(tr.select("fold", group).distinct(), ["fold", group])
    s = shared.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("shared_sessions"))
    g = groups.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("shared_groups"))
    out = join_on(join_on(late, s, ["fold", "role"]), g, ["fold", "role"]).fillna(0)
    return out.unpivot(["fold", "role"], ["ends_after_start", "inside_embargo", "shared_sessions", "shared_groups"], "rule", "violations")


def partition_summary(assignment: DataFrame) -> DataFrame:
    """Sessions, events, positives, users and time range per fold and role."""
    return assignment.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"),
        F.sum("positive_events").alias("positive_events"), F.sum("negative_events").alias("negative_events"),
        F.sum("has_positive").alias("positive_sessions"), F.count_distinct("group").alias("users"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
    )


