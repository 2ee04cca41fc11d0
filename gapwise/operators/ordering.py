"""Canonical order, de-duplication and time since the previous event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import previous, scan

EPSILON_MIN = 1e-6


def strict_order(
    df: DataFrame, user: str = "uid", epoch: str = "epoch_s", index: str = "row_index", arrival: str | None = None
) -> DataFrame:
    """Keep, per user and millisecond, rows told apart by ``index``.

    Rows without an index at an instant that already has a row are dropped, and
    equal indexes count once: the first by ``arrival`` (a column that numbers rows
    as they came) stays.  Without ``arrival`` the earliest stays and, of rows equal
    in that too, the one with the least digest of all its columns, so a rerun keeps
    the same row.  The group of a window is one user millisecond.
    """
    second = F.when(F.col(epoch) < 0, F.ceil(epoch)).otherwise(F.floor(epoch)).cast("long")
    part = F.col(epoch) - second
    milli = F.when(part > 0, F.floor(part * 1000 + 0.5)).otherwise(0).cast("int")
    digest = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    ties = [F.col(arrival)] if arrival else [F.col(epoch), digest]
    w = Window.partitionBy(user, "_sec", "_ms").orderBy(F.col(index).asc_nulls_last(), *ties)
    return (
        df.where(F.col(epoch).isNotNull())
        .withColumns({"_sec": second, "_ms": milli})
        .withColumns({"_rn": F.row_number().over(w), "_before": F.lag(index).over(w)})
        .where((F.col("_rn") == 1) | (F.col(index) > F.col("_before")))
        .drop("_sec", "_ms", "_rn", "_before")
    )


def delta_labels(
    df: DataFrame,
    keys: Sequence[str] = ("uid",),
    epoch: str = "epoch_s",
    index: str = "row_index",
    epsilon: float = EPSILON_MIN,
    epsilon_t: float = 0.0,
) -> DataFrame:
    """``delta_seconds`` to the previous row and ``time_label``.

    The first row of a key is ``initial`` without a delta; other deltas are
    floored at epsilon and labelled ``unknown`` up to epsilon_t, else ``measured``.
    """
    eps = max(epsilon, EPSILON_MIN)
    eps_t = max(epsilon_t, eps)
    raw = F.col(epoch) - F.col("_prev")
    delta = F.when(raw >= 0, F.greatest(raw, F.lit(eps)))
    out = scan(df, keys, [epoch, index], {"_prev": previous(epoch)})
    out = out.withColumn("delta_seconds", delta).drop("_prev")
    d = F.col("delta_seconds")
    return out.withColumn(
        "time_label", F.when(d.isNull(), "initial").when(d <= eps_t, "unknown").otherwise("measured")
    )


def label_counts(df: DataFrame) -> DataFrame:
    """Number of rows per label."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("time_label") == k).alias(k) for k in ("initial", "measured", "unknown")],
    )
