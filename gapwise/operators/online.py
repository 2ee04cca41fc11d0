"""Trimmed, drift-limited running median and scale of a key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import chunk_column, durable, is_cut, join_on, split, spread, union_all

FLOOR = 1e-12
SCALE = 1.4826


def _toward(target: float, now: float, scale: float, max_drift: float) -> float:
    """Move to target, at most max_drift of the larger of |now| and scale."""
    if max_drift <= 0 or not math.isfinite(target):
        return now
    room = max(abs(now), scale, FLOOR) * max_drift
    return now + min(room, max(-room, target - now))


def update(x: float, med: float, smad: float, alpha: float, trim: tuple[float, float], max_drift: float) -> tuple[float, float]:
    """New median and scale after one value."""
    if not math.isfinite(x) or alpha == 0:
        return med, smad
    s = max(smad, FLOOR)
    kept = min(med + trim[1] * s, max(med - trim[0] * s, x))
    new_med = _toward((1 - alpha) * med + alpha * kept, med, s, max_drift)
    off = max(abs(kept - new_med), FLOOR)
    new_smad = max(FLOOR, _toward((1 - alpha) * s + alpha * off, s, s, max_drift))
    return new_med, new_smad


def running_stats(
    df: DataFrame, start: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.05,
    trim: tuple[float, float] = (3.0, 3.0), max_drift: float = 0.1,
) -> DataFrame:
    """A7 along ``order``: x_med, x_smad after each row, from the key's ``start`` values.

    The recursion cannot be reordered.  A hot key is therefore walked chunk by
    chunk: each round handles one chunk of every key that still has one, with
    the state of the round before, so no task holds more than a chunk.
    """
    keys, order = list(keys), list(order)
    df = split(df, keys, order[0])
    chunk = chunk_column(keys, order[0])
    fields = [f for f in df.schema.fields if f.name != chunk]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["x_med double", "x_smad double"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        med, smad = float(pdf["_m"].iloc[0]), float(pdf["_s"].iloc[0])
        meds, smads = [], []
        for x in pdf[value].to_numpy(float):
            med, smad = update(x, med, smad, alpha, trim, max_drift)
            meds.append(med)
            smads.append(smad)
        return pdf[[f.name for f in fields]].assign(x_med=meds, x_smad=smads)

    state = start.select(*keys, F.col("x_med").alias("_m"), F.col("x_smad").alias("_s"))

    def round_of(rows: DataFrame, state: DataFrame) -> DataFrame:
        return spread(join_on(rows, state, keys, "inner"), keys).groupBy(*keys).applyInPandas(walk, schema)

    if not is_cut(df, keys, order[0]):
        return round_of(df, state)
    df = durable(df)
    done = [durable(round_of(df.where(F.col(chunk) <= 0), state))]
    for i in range(1, (df.agg(F.max(chunk)).first()[0] or 0) + 1):
        last = F.max_by(F.struct("x_med", "x_smad"), F.struct(*order))
        after = done[-1].groupBy(*keys).agg(last.alias("_l")).select(*keys, F.col("_l.x_med").alias("_m"), F.col("_l.x_smad").alias("_s"))
        state = durable(join_on(state, after.withColumnsRenamed({"_m": "_nm", "_s": "_ns"}), keys).select(
            *keys, F.coalesce("_nm", "_m").alias("_m"), F.coalesce("_ns", "_s").alias("_s")
        ))
        done.append(durable(round_of(df.where(F.col(chunk) == i), state)))
    return union_all(done)
