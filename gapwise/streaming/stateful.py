"""Stateful streaming operators (ST1-ST5).

Each operator is one function from the rows of a key in a trigger, in order, and
the state kept so far to output rows and new state.  A trigger bounds how many
rows of a key are in memory; ``maxFilesPerTrigger`` or the source's rate limit
bounds the trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import session_key
from ..operators.latches import _transitions
from ..operators.sessions import RULE_VERSION
from ..operators.tailfit import CANDIDATES, calibrate_sample


def _collect(parts: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


def _fields(df: DataFrame, extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [extra])


def _apply(df: DataFrame, keys, step: Callable, out: str, state: str, timeout=GroupStateTimeout.NoTimeout) -> DataFrame:
    return df.groupBy(*keys).applyInPandasWithState(step, out, state, "append", timeout)


# ST1 ------------------------------------------------------------------------


def stream_sessions(
    df: DataFrame, idle: float = 1800.0, user: str = "uid", epoch: str = "epoch_s", index: str = "row_index",
    source_session: str = "session_id", key: bytes | None = None, version: str = RULE_VERSION,
) -> DataFrame:
    """ST1: W5 on a stream; the last row of each user is carried across triggers."""

    def step(_, parts, state: GroupState):
        pdf = _collect(parts, [index])
        last_t, last_s, seq, idx, start = state.get if state.exists else (None, None, -1, -1, None)
        t = pdf[epoch].to_numpy(float)
        s = pdf[source_session].fillna("").to_numpy(object)
        before = np.concatenate([[np.nan if last_t is None else last_t], t[:-1]])
        prev_s = np.concatenate([[last_s], s[:-1]])
        gap = t - before
        reason = np.where(
            np.isnan(before), "initial",
            np.where(gap < 0, "timestamp_regression",
                     np.where(gap > idle, "idle_timeout", np.where(s != prev_s, "session_id_change", "continuous"))),
        )
        begins = reason != "continuous"
        number = seq + np.cumsum(begins)
        place = np.arange(len(t))
        last_begin = np.maximum.accumulate(np.where(begins, place, -1))
        inside = np.where(last_begin >= 0, place - last_begin, idx + 1 + place)
        began = np.where(last_begin >= 0, t[np.maximum(last_begin, 0)], np.nan if start is None else start)
        state.update((float(t[-1]), str(s[-1]), int(number[-1]), int(inside[-1]), float(began[-1])))
        yield pdf.assign(
            split_reason=reason, delta_seconds=np.where(begins, np.nan, gap),
            session_sequence=number.astype("int64"), session_index=inside.astype("int64"), session_start=began,
        )

    extra = "split_reason string, delta_seconds double, session_sequence bigint, session_index bigint, session_start double"
    state = "last_t double, last_s string, seq bigint, idx bigint, start double"
    out = _apply(df, [user], step, _fields(df, extra), state)
    out = out.withColumn("delta_seconds", F.nanvl("delta_seconds", F.lit(None).cast("double")))
    if key is not None:
        out = out.withColumn("generated_session_id", session_key(key, F.col(user), F.col("session_start"), version))
    return out


def closed_sessions(df: DataFrame, gap: str, delay: str, user: str = "uid", ts: str = "ts") -> DataFrame:
    """ST1: finished sessions by built-in session windows behind a watermark."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), user)
        .agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .drop("w")
    )


# ST2 ------------------------------------------------------------------------


def _r7(sorted_values: np.ndarray, q: float) -> float:
    pos = (len(sorted_values) - 1) * q
    low = int(pos)
    high = min(low + 1, len(sorted_values) - 1)
    return float(sorted_values[low] + (pos - low) * (sorted_values[high] - sorted_values[low]))


def stream_features(
    df: DataFrame, epsilon: float, epsilon_t: float, clip_seconds: float, window: int = 10,
    levels: Sequence[float] = (0.25, 0.5, 0.75), user: str = "uid", session: str = "session_id",
    epoch: str = "epoch_s", index: str = "row_index",
) -> DataFrame:
    """ST2: features of the gap inside the session; a changed session resets the user's state."""
    names = [f"delta_m{round(q * 100)}" for q in levels]
    eps_t = max(epsilon, epsilon_t)

    def step(_, parts, state: GroupState):
        pdf = _collect(parts, [epoch, index])
        sid, seq, start, prev_t, prev_d, hist = state.get if state.exists else (None, 0, None, None, None, [])
        hist = list(hist)
        rows = []
        for s, t in zip(pdf[session].tolist(), pdf[epoch].tolist(), strict=True):
            if s != sid:
                sid, seq, start, prev_t, prev_d, hist = s, 0, t, None, None, []
            gap = t - prev_t if prev_t is not None else -1.0
            delta = max(gap, epsilon) if seq > 0 and gap >= 0 else None
            label = "initial" if delta is None else "unknown" if gap <= eps_t else "measured"
            known = np.sort(np.array(hist)) if hist else None
            burst = None
            if label == "measured" and prev_d is not None:
                burst = min(5.0, max(-5.0, float(np.log((prev_d + epsilon) / (delta + epsilon)))))
            rows.append(
                (delta, label, min(delta, clip_seconds) if delta is not None else None, burst, seq, max(t - start, 0.0), seq == 0,
                 *[_r7(known, q) if known is not None else None for q in levels])
            )
            prev_d = delta if label == "measured" else None
            if label == "measured":
                hist = [*hist, min(delta, clip_seconds)][-window:]
            seq, prev_t = seq + 1, t
        state.update((sid, seq, start, prev_t, prev_d, hist))
        cols = ["delta_seconds", "time_label", "delta_clipped_seconds", "delta_log_burst", "session_sequence",
                "session_elapsed_seconds", "is_session_start", *names]
        yield pd.concat([pdf, pd.DataFrame(rows, columns=cols)], axis=1)

    extra = (
        "delta_seconds double, time_label string, delta_clipped_seconds double, delta_log_burst double, "
        "session_sequence bigint, session_elapsed_seconds double, is_session_start boolean"
        + "".join(f", {n} double" for n in names)
    )
    state = "sid string, seq bigint, start double, prev_t double, prev_d double, hist array<double>"
    out = _apply(df, [user], step, _fields(df, extra), state)
    doubles = ["delta_seconds", "delta_clipped_seconds", "delta_log_burst", *names]
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles})


def with_frozen_stats(features: DataFrame, stats: DataFrame, epsilon: float, floor: float = 1e-9, bound: float = 5.0,
                      user: str = "uid", epoch: str = "epoch_s") -> DataFrame:
    """ST2: z-scores of streamed features against a fitted table (A4), a stream-static join.

    The table's statistics are in the log domain and keyed by user, with a
    global row per hour for unseen users.
    """
    from ..functions.timestamps import utc_hour
    from ..operators.contract import clip
    from ..scale import at_least, join_on

    own = stats.where("level = 'key' AND hour IS NOT NULL").select(user, "hour", F.col("x_med").alias("_um"), F.col("x_smad").alias("_us"))
    glob = stats.where("level = 'global' AND hour IS NOT NULL").select("hour", F.col("x_med").alias("_gm"), F.col("x_smad").alias("_gs"))
    out = features.withColumn("hour", utc_hour(F.col(epoch)))
    out = join_on(join_on(out, own, [user, "hour"]), F.broadcast(glob), ["hour"])  # 24 rows
    x = F.ln(at_least(F.col("delta_clipped_seconds"), epsilon) + epsilon)
    z = (x - F.coalesce("_um", "_gm")) / at_least(F.coalesce("_us", "_gs"), floor)
    return out.withColumn("delta_z_deseas_clipped", clip(z, bound)).drop("hour", "_um", "_us", "_gm", "_gs")


# ST3 ------------------------------------------------------------------------


def _level(u: float, xi: float, beta: float, p_ref: float, q_star: float, last: float) -> float:
    """Threshold that never falls, except to the end point of a bounded tail."""
    ratio = max(p_ref / max(q_star, 1e-12), 1e-12)
    beta = max(beta, 1e-12)
    now = u + beta * np.log(ratio) if abs(xi) < 1e-12 else u + beta / xi * (ratio**xi - 1)
    now = max(now if np.isfinite(now) else u, u)
    if xi < 0:
        end = u - beta / xi
        return float(max(min(now, end), min(last, end)))
    return float(max(now, last))


def stream_scores(
    df: DataFrame, entry: str = "entry", value: str = "delta_seconds", domain: str = "log_dt", index: str = "row_index",
    k: int = 3, n: int = 5, h: float = 1.1, every: int = 10_000, min_exceed: int = 5, min_tail: int = 50,
    candidates: Sequence[float] = CANDIDATES, q: float = 1e-3, r: int = 5, xi_eps: float = 1e-6,
) -> DataFrame:
    """ST3: evt ratio, latch L4 and re-estimation C6 per tail entry.

    Rows carry the parameters of their resolved entry (u, xi, beta, p_ref,
    q_star); they start the state and are replaced by re-estimated ones.  The
    state keeps at most ``every`` exceedances.
    """
    table = _transitions(k, n)
    latched = 2 ** (n - 1)

    def step(_, parts, state: GroupState):
        pdf = _collect(parts, [index])
        first = pdf.iloc[0]
        if state.exists:
            u, xi, beta, p_ref, q_star, tau, mode, seen, xs, at = state.get
        else:
            u, xi, beta, p_ref, q_star = (float(first[c]) for c in ("u", "xi", "beta", "p_ref", "q_star"))
            tau, mode, seen, xs, at = _level(u, xi, beta, p_ref, q_star, u), 0, 0, [], []
        xs, at = list(xs), list(at)
        ratio, alarm, refit = [], [], []
        for x, y, i in zip(pdf[value].tolist(), pdf[domain].tolist(), pdf[index].tolist(), strict=True):
            tau = _level(u, xi, beta, p_ref, q_star, tau)
            s = max(x, 0.0) / max(float(np.exp(tau)), 1e-12)
            mode = int(table[int(s > 1), int(s <= 1.0 / h), mode])
            ratio.append(s)
            alarm.append(mode == latched)
            seen += 1
            if y > u:
                xs.append(float(y))
                at.append(int(i))
            fresh = False
            if every > 0 and seen >= every:
                if len(xs) >= min_exceed and len(xs) >= min_tail:
                    got = calibrate_sample(np.array(xs), np.array(at), candidates, min_tail, q, r, xi_eps)
                    u, xi, beta, p_ref, q_star = (float(got[c]) for c in ("u", "xi", "beta", "p_ref", "q_star"))
                    tau = _level(u, xi, beta, p_ref, q_star, tau)
                    mode, fresh = 0, True
                seen, xs, at = 0, [], []
            refit.append(fresh)
        state.update((u, xi, beta, p_ref, q_star, float(tau), mode, seen, xs, at))
        yield pdf.assign(s_evt=ratio, alarm=alarm, refit=refit)

    state = (
        "u double, xi double, beta double, p_ref double, q_star double, tau double, mode int, seen bigint, "
        "xs array<double>, at array<bigint>"
    )
    return _apply(df, [entry], step, _fields(df, "s_evt double, alarm boolean, refit boolean"), state)


# ST4 ------------------------------------------------------------------------


def stream_ratio_latch(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, ratio: str, k: int, n: int, h: float) -> DataFrame:
    """ST4: L2 on a stream: k-of-n votes with ratio release per session."""

    def step(_, parts, state: GroupState):
        pdf = _collect(parts, order)
        recent, on = state.get if state.exists else ([], False)
        recent = list(recent)
        votes, alarm = [], []
        for f, s in zip(pdf[flag].fillna(False).to_numpy(bool), pdf[ratio].to_numpy(float), strict=True):
            recent = [*recent, int(f)][-n:]
            c = sum(recent)
            on = c >= k or (on and not s <= 1.0 / h)
            votes.append(c)
            alarm.append(on)
        state.update((recent, bool(on)))
        yield pdf.assign(votes=np.array(votes, dtype="int32"), alarm=alarm)

    return _apply(df, list(keys), step, _fields(df, "votes int, alarm boolean"), "recent array<int>, on boolean")


# ST5 ------------------------------------------------------------------------


def stream_closed_session_rows(df: DataFrame, user: str, session: str, order: Sequence[str], idle: float, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """ST5: rows leave only with their finished session.

    The open session of a user waits in the state until another session of the
    user starts or the watermark passes its last event by ``idle`` seconds.
    """
    cols = [f.name for f in df.schema.fields]
    row_type = df.select(F.struct(*cols).alias("r")).schema["r"].dataType.simpleString()
    epoch = order[0]

    def step(_, parts, state: GroupState):
        if state.hasTimedOut:
            (held,) = state.get
            state.remove()
            yield pd.DataFrame([tuple(r) for r in held], columns=cols)
            return
        pdf = _collect(parts, order)
        if state.exists:
            (held,) = state.get
            pdf = pd.concat([pd.DataFrame([tuple(r) for r in held], columns=cols), pdf], ignore_index=True)
        still = pdf[session] == pdf[session].iloc[-1]
        # rows of the last session that an earlier session interrupted belong to a finished run
        run = still & (~still[::-1]).cumsum()[::-1].eq(0)
        state.update(([tuple(r) for r in pdf[run].itertuples(index=False)],))
        limit = int((float(pdf[epoch].iloc[-1]) + idle) * 1000)
        state.setTimeoutTimestamp(max(limit, state.getCurrentWatermarkMs() + 1))
        yield pdf[~run]

    marked = df.withWatermark(ts, delay)
    return _apply(marked, [user], step, _fields(df, "")[:-2], f"held array<{row_type}>", GroupStateTimeout.EventTimeTimeout)


def entry_column(user: str = "uid", category: str = "op_category", shared_global: bool = False) -> Column:
    """Key of ST3: the resolved entry; unseen users get their own key unless ``shared_global``."""
    own = F.concat_ws("||", F.col("entry_uid"), F.col("entry_category"))
    if shared_global:
        return own
    return F.when(F.col("entry_uid") == "__global__", F.concat_ws("||", F.lit("__global__"), F.col(user), F.col(category))).otherwise(own)
