"""Session rules (W4-W8), session tables (A16) and the transition audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import session_key
from ..scale import at_least, first_of, join_on, last_seen, previous, running_sum, scan


# fixed value: version text that enters session ids
RULE_VERSION = "otsu+kneedle-v1"


def _number_sessions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, epoch: str
) -> DataFrame:
    """Session number, index inside the session and start time from start flags."""
    keys = list(keys)
    out = df.withColumn("_start", start)
    out = scan(out, keys, order, {"_no": running_sum(F.col("_start").cast("long"))})
    out = scan(
        out,
        [*keys, "_no"],
        order,
        {"_idx": running_sum(F.lit(1)), "session_start": first_of(epoch)},
    )
    return (
        out.withColumn("session_sequence", F.col("_no") - 1)
        .withColumn("session_index", F.col("_idx") - 1)
        .drop("_no", "_idx")
    )


def default_sid(uid: str = "uid") -> Column:
    return F.concat_ws(":", F.col(uid), F.col("session_sequence").cast("string"))


def sessions_by_label(
    df: DataFrame,
    threshold: float,
    keys: Sequence[str] = ("uid",),
    epoch: str = "epoch_s",
    index: str = "row_index",
    make_sid: Callable[[], Column] = default_sid,
) -> DataFrame:
    """A session starts at ``initial`` rows and at measured gaps above threshold.

    ``make_sid`` (X1) builds the id column from the finished session columns.
    """
    start = (F.col("time_label") == "initial") | (
        (F.col("time_label") == "measured") & (F.col("delta_seconds") > threshold)
    )
    out = _number_sessions(df, keys, [epoch, index], start, epoch)
    return out.withColumn("sid", make_sid()).drop("_start")


def sessions_in_arrival_order(
    df: DataFrame,
    idle: float = 1800.0,
    key: bytes | None = None,
    version: str = RULE_VERSION,
    user: str = "uid",
    epoch: str = "epoch_s",
    index: str = "row_index",
    source_session: str | None = "session_id",
) -> DataFrame:
    """Rows stay in arrival order; going back in time starts a session.

    Precedence: first row, time going back, gap above idle, changed source
    session.  The gap is NULL on every session start.
    """
    steps = {"_pt": previous(epoch)}
    if source_session:
        steps["_ps"] = previous(F.coalesce(F.col(source_session), F.lit("")))
    out = scan(df, [user], [index], steps)
    gap = F.col(epoch) - F.col("_pt")
    changed = F.lit(False)
    if source_session:
        changed = F.coalesce(F.col(source_session), F.lit("")) != F.col("_ps")
    out = out.withColumn("_gap", gap).withColumn(
        "split_reason",
        F.when(F.col("_pt").isNull(), "initial")
        .when(F.col("_gap") < 0, "timestamp_regression")
        .when(F.col("_gap") > idle, "idle_timeout")
        .when(changed, "session_id_change")
        .otherwise("continuous"),
    )
    going_on = F.col("split_reason") == "continuous"
    out = out.withColumn("delta_seconds", F.when(going_on, F.col("_gap"))).drop("_gap", "_pt", "_ps")
    out = _number_sessions(out, [user], [index], ~going_on, epoch).drop("_start")
    if key is not None:
        out = out.withColumn(
            "generated_session_id", session_key(key, F.col(user), F.col("session_start"), version)
        )
    return out


def sessions_given_or_idle(
    df: DataFrame,
    idle: float,
    given: bool,
    user: str = "uid",
    session: str = "session_id",
    epoch: str = "epoch_s",
    index: str = "row_index",
) -> DataFrame:
    """Keep given session ids, or make ids ``uid-<nanoseconds>`` at gaps above idle.

    ``delta_t`` is 0 on the first row of a session and never negative.
    """
    if given:
        out = scan(df, [session], [epoch, index], {"_pt": previous(epoch)})
        gap = F.greatest(F.coalesce(F.col(epoch) - F.col("_pt"), F.lit(0.0)), F.lit(0.0))
        return out.withColumn("delta_t", gap).drop("_pt")
    out = scan(df, [user], [epoch, index], {"_pt": previous(epoch)})
    gap = at_least(F.col(epoch) - F.col("_pt"), 0.0)
    start = gap.isNull() | (gap > idle)
    out = out.withColumn("delta_t", F.when(start, 0.0).otherwise(gap)).withColumn("_start", start).drop("_pt")
    ns = F.round(F.col(epoch) * 1e6).cast("long") * 1000
    sid = F.when(F.col("_start"), F.concat_ws("-", F.col(user), ns.cast("string")))
    out = out.withColumn(session, sid)
    return scan(out, [user], [epoch, index], {session: last_seen(session, inclusive=True)}).drop("_start")


def sessions_by_user_threshold(
    df: DataFrame,
    thresholds: DataFrame,
    keys: Sequence[str] = ("uid",),
    tau: str = "tau",
    epoch: str = "epoch_s",
    index: str = "row_index",
) -> DataFrame:
    """Per-user threshold; a gap of at least tau starts a session, no tau never does."""
    limits = thresholds.select(*keys, F.col(tau).alias("_tau"))
    out = join_on(df, limits, list(keys))
    start = F.col("delta_seconds").isNull() | F.coalesce(F.col("delta_seconds") >= F.col("_tau"), F.lit(False))
    return _number_sessions(out, keys, [epoch, index], start, epoch).drop("_start", "_tau")


def sessions_by_counter(
    df: DataFrame, idle: float, user: str = "uid", epoch: str = "epoch_s", index: str = "row_index"
) -> DataFrame:
    """Counter that grows at missing, negative or above-idle gaps."""
    out = scan(df, [user], [epoch, index], {"_pt": previous(epoch)})
    gap = F.col(epoch) - F.col("_pt")
    start = gap.isNull() | (gap < 0) | (gap > idle)
    out = out.withColumn("_start", start.cast("long")).drop("_pt")
    out = scan(out, [user], [epoch, index], {"session_no": running_sum("_start")}).drop("_start")
    return out.withColumn("session_label", F.concat_ws("_", F.col(user), F.col("session_no").cast("string")))


def session_table(
    df: DataFrame,
    session: str = "session_id",
    group: str = "uid",
    epoch: str = "epoch_s",
    index: str = "row_index",
    label: str | None = "label",
) -> DataFrame:
    """One row per session; a plain aggregate, so partial sums cross the network."""
    positive = F.count_if(F.coalesce(F.col(label).cast("double"), F.lit(0.0)) > 0) if label else F.lit(0)
    out = df.groupBy(F.col(session).alias("session_id")).agg(
        F.min_by(group, F.struct(epoch, index)).alias("group"),
        F.min(epoch).alias("start_s"),
        F.max(epoch).alias("end_s"),
        F.count(F.lit(1)).alias("events"),
        positive.cast("long").alias("positive_events"),
    )
    return out.withColumns(
        {
            "duration": F.col("end_s") - F.col("start_s"),
            "negative_events": F.col("events") - F.col("positive_events"),
            "has_positive": (F.col("positive_events") > 0).cast("int"),
        }
    )


def session_gaps(
    df: DataFrame, group: str = "uid", session: str = "session_id", epoch: str = "epoch_s", index: str = "row_index"
) -> DataFrame:
    """Gaps between consecutive events of the same group and session."""
    out = scan(df, [group, session], [epoch, index], {"_pt": previous(epoch)})
    return out.withColumn("gap_s", F.col(epoch) - F.col("_pt")).drop("_pt").where("gap_s IS NOT NULL")


def transition_findings(
    df: DataFrame,
    user: str = "uid",
    session: str = "sid_final",
    epoch: str = "epoch_s",
    index: str = "row_index",
    delta: str = "dt_sec",
    threshold: str = "threshold",
    user_threshold: str = "user_threshold",
    tolerance: float = 1e-6,
) -> DataFrame:
    """Every change of the session id needs a gap above the threshold.

    The threshold is taken from the row, the previous row or the user; the gap
    from the row or from the clock.
    """
    out = scan(
        df,
        [user],
        [epoch, index],
        {"_ps": previous(session), "_pt": previous(epoch), "_pth": previous(threshold)},
    )
    out = out.where(F.col("_ps").isNotNull() & F.col(session).isNotNull() & (F.col("_ps") != F.col(session)))
    limit = F.coalesce(F.col(threshold), F.col("_pth"), F.col(user_threshold))
    gap = F.coalesce(F.col(delta), F.col(epoch) - F.col("_pt"))
    return out.withColumns({"limit_s": limit, "gap_s": gap}).withColumn(
        "finding",
        F.when(F.col("limit_s").isNull(), "missing_threshold")
        .when(F.col("gap_s").isNull(), "missing_delta")
        .when(F.col("gap_s") <= F.col("limit_s") + tolerance, "below_threshold")
        .otherwise("ok"),
    ).drop("_ps", "_pt", "_pth")
