"""Joins, set checks and ordered picks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import join_on, last_seen, running_max, running_sum, scan, union_all


def joined_scores(base: DataFrame, scores: Sequence[DataFrame], key: str = "row_index") -> DataFrame:
    """Inner join of score tables on a unique key."""
    return reduce(lambda a, b: a.join(b, key, "inner"), scores, base)


def join_report(base: DataFrame, other: DataFrame, key: str = "row_index") -> DataFrame:
    """Repeated keys on either side and base rows without partner, in one pass over both."""
    a = base.select(key, F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = other.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    per = a.unionByName(b).groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per.agg(
        F.count_if(F.col("a") > 1).alias("repeated_left"),
        F.count_if(F.col("b") > 1).alias("repeated_right"),
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("unmatched"),
    )


def require_clean_join(base: DataFrame, other: DataFrame, key: str = "row_index") -> None:
    r = join_report(base, other, key).first()
    if r["repeated_left"] or r["repeated_right"] or r["unmatched"]:
        raise ValueError(f"join on {key} would change the rows: {r.asDict()}")


def truth_with_predictions(truth: DataFrame, pred: DataFrame, keys: Sequence[str], suffixes=("_truth", "_pred")) -> DataFrame:
    """Inner join; shared other columns get suffixes."""
    shared = [c for c in truth.columns if c in pred.columns and c not in keys]
    a = truth.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    b = pred.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return a.join(b, list(keys), "inner")


def add_features(base: DataFrame, extra: DataFrame, keys: Sequence[str], source_order: str) -> DataFrame:
    """Left join of new columns; of several rows per key the first in source order counts.

    The first row is an aggregate, not a sort of each key's rows.
    """
    on = [k for k in keys if k in base.columns and k in extra.columns]
    new = [c for c in extra.columns if c not in base.columns]
    first = extra.groupBy(*on).agg(F.min_by(F.struct(*new), source_order).alias("_f"))
    return join_on(base, first, on).select(*base.columns, *[F.col(f"_f.{c}").alias(c) for c in new])


def aligned_report(a: DataFrame, b: DataFrame, shared: Sequence[str], index: str = "row_index") -> DataFrame:
    """Rows whose shared columns differ between two row-aligned tables, and unmatched rows."""
    other = b.select(F.col(index), F.struct(*shared).alias("_b"))
    both = a.select(index, F.struct(*shared).alias("_a")).join(other, index, "full")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"),
    )


def rows_of_fold(events: DataFrame, assignment: DataFrame, fold: int, role: str, session: str = "session_id") -> DataFrame:
    """Events of the sessions that have a role in a fold."""
    keep = assignment.where((F.col("fold") == fold) & (F.col("role") == role)).select(session)
    return events.join(keep, session, "left_semi")


def without_groups(sessions: DataFrame, held_out: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions whose key is not held out."""
    return sessions.join(held_out.select(*keys).distinct(), list(keys), "left_anti")


def merged_intervals(df: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Union of overlapping closed intervals."""
    keys = list(keys)
    rows = df.select(*keys, F.col(start).alias("start_s"), F.col(end).alias("end_s"))
    rows = scan(rows, keys, ["start_s", "end_s"], {"_reach": running_max("end_s", inclusive=False)})
    new = (F.col("_reach").isNull() | (F.col("start_s") > F.col("_reach"))).cast("long")
    rows = scan(rows.withColumn("_new", new), keys, ["start_s", "end_s"], {"_g": running_sum("_new")})
    return rows.groupBy(*keys, "_g").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_g")


def outside_intervals(rows: DataFrame, intervals: DataFrame, at: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows that lie in none of the closed intervals (start_s, end_s).

    Merged intervals and rows are put in one order; the last interval that
    started decides.  No row meets more than one interval.
    """
    keys = list(keys)
    m = merged_intervals(intervals, "start_s", "end_s", keys)
    marks = m.select(*keys, F.col("start_s").alias("_at"), F.lit(0).alias("_kind"), F.col("end_s").alias("_end"),
                     F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_row"))
    data = rows.select(*keys, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"),
                       F.lit(None).cast("double").alias("_end"), F.struct(*rows.columns).alias("_row"))
    both = scan(marks.unionByName(data), keys, ["_at", "_kind"], {"_open": last_seen("_end", inclusive=True)})
    inside = F.coalesce(F.col("_at") <= F.col("_open"), F.lit(False))
    return both.where((F.col("_kind") == 1) & ~inside).select("_row.*")


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Tables one after the other, missing columns as NULL, with source and position."""
    return union_all([f.withColumn("source_no", F.lit(i)) for i, f in enumerate(frames)])


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values present in both tables (must be empty for a clean split)."""
    return a.select(column).intersect(b.select(column))


def distinct_entities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations."""
    return df.select(*columns).distinct()


def top_anomalies(df: DataFrame, score: str, n: int = 20, label: str | None = "label", ties: Sequence[str] = ("row_index",)) -> DataFrame:
    """O1: highest scores among labelled rows; a take-ordered, not a full sort."""
    rows = df.where(F.col(label) == 1) if label else df
    return rows.orderBy(F.desc(score), *ties).limit(n)


def session_order(sessions: DataFrame, start: str = "start_s", ties: Sequence[str | Column] = ("session_id",)) -> DataFrame:
    """O2: rank of sessions by first time, then explicit tie columns."""
    named = {f"_t{i}": (F.col(t) if isinstance(t, str) else t) for i, t in enumerate(ties)}
    out = scan(sessions.withColumns(named), [], [start, *named], {"rank": running_sum(F.lit(1))})
    return out.withColumn("rank", F.col("rank") - 1).drop(*named)


def head_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """O3: first n rows per key; hot keys are numbered chunk by chunk."""
    out = scan(df, list(keys), list(order), {"_rn": running_sum(F.lit(1))})
    return out.where(F.col("_rn") <= n).drop("_rn")


