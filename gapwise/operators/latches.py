"""Voting and hysteresis over ordered rows (L1-L4)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import chunk_column, durable, is_cut, join_on, last_seen, scan, split, spread, trailing
from .groups import numbered


def _votes(flag: str, n: int):
    return trailing(F.coalesce(F.col(flag).cast("int"), F.lit(0)), n, inclusive=True)


def _sum(arr: str) -> Column:
    return F.aggregate(arr, F.lit(0), lambda a, x: a + x)


def vote_and_hold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, window: int = 1, votes: int = 1, hold: int = 0
) -> DataFrame:
    """L1: ``alarm`` when enough of the last rows are flagged, kept for ``hold`` further rows."""
    votes = min(max(votes, 1), window)
    out = scan(df, keys, order, {"_v": _votes(flag, window)})
    out = out.withColumn("_hit", (_sum("_v") >= votes).cast("int"))
    out = scan(out, keys, order, {"_h": _votes("_hit", hold + 1)})
    return out.withColumn("alarm", _sum("_h") > 0).drop("_v", "_hit", "_h")


def _latched(df: DataFrame, keys, order, set_on: Column, release_on: Column) -> DataFrame:
    mark = F.when(set_on, 1).when(release_on, 0)
    out = scan(df.withColumn("_mark", mark), keys, order, {"_state": last_seen("_mark", inclusive=True)})
    return out.withColumn("alarm", F.coalesce(F.col("_state"), F.lit(0)) == 1).drop("_mark", "_state")


def ratio_latch(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, ratio: str, k: int, n: int, h: float
) -> DataFrame:
    """L2: set by k of n, released once fewer than k votes remain and ratio <= 1/h."""
    out = scan(df, keys, order, {"_v": _votes(flag, n)}).withColumn("votes", _sum("_v")).drop("_v")
    active = F.col("votes") >= k
    return _latched(out, keys, order, active, ~active & (F.col(ratio) <= 1.0 / h))


def count_latch(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, k: int, n: int, up: float, down: float
) -> DataFrame:
    """L3: set at ``up`` votes, released at ``down``; values up to 1 are shares of n."""

    def level(value: float, base: int) -> int:
        return min(n, max(base, math.ceil(value * n if value <= 1 else value)))

    rise = level(up, k)
    fall = max(min(level(down, 0), rise - 1), 0)
    out = scan(df, keys, order, {"_v": _votes(flag, n)}).withColumn("votes", _sum("_v")).drop("_v")
    return _latched(out, keys, order, F.col("votes") >= rise, F.col("votes") <= fall)


# L4 ------------------------------------------------------------------------
# State before a row: the last n-1 votes as bits (absent votes count as 0), or
# LATCHED.  Release clears the votes, so the state set is small and the effect
# of a run of rows is a table from state to state: runs of one key can be
# evaluated in parallel and chained by looking up one table after the other.


def _transitions(k: int, n: int) -> np.ndarray:
    """Next state for [exceed, release, state]."""
    states = 2 ** (n - 1)
    table = np.zeros((2, 2, states + 1), dtype=np.int64)
    bits = np.arange(states)
    ones = np.array([int(b).bit_count() for b in bits])
    for e in (0, 1):
        moved = ((bits << 1) | e) & (states - 1)
        table[e, :, :states] = np.where(ones + e >= k, states, moved)
        table[e, 0, states] = states
        table[e, 1, states] = 0
    return table


def clearing_latch(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ratio: str, k: int = 3, n: int = 5, h: float = 1.1
) -> DataFrame:
    """L4: set by k of n rows with ratio > 1; released at ratio <= 1/h, which forgets all votes."""
    table = _transitions(k, n)
    latched = 2 ** (n - 1)
    keys, order = list(keys), list(order)
    df = split(df, keys, order[0])
    chunk = chunk_column(keys, order[0])
    cut = is_cut(df, keys, order[0])
    part = keys + ([chunk] if cut else [])
    df = df.withColumns(
        {
            "_e": F.coalesce((F.col(ratio) > 1).cast("int"), F.lit(0)),
            "_r": F.coalesce((F.col(ratio) <= 1.0 / h).cast("int"), F.lit(0)),
        }
    )

    def effect(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state = np.arange(latched + 1)
        for e, r in zip(pdf["_e"].to_numpy(), pdf["_r"].to_numpy(), strict=True):
            state = table[e, r][state]
        return pd.DataFrame([[*group, state.tolist()]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, walk = 0, table.tolist()
        for pdf in frames:
            alarm = np.zeros(len(pdf), dtype=bool)
            steps = zip(*[pdf[c].tolist() for c in ("_no", "_e", "_r", "_from")], strict=True)
            for i, (no, e, r, begin) in enumerate(steps):
                state = walk[e][r][begin if no == 1 else state]
                alarm[i] = state == latched
            yield pdf.drop(columns=["_e", "_r", "_from", "_no"]).assign(alarm=alarm)

    if cut:
        slim = df.where(F.col(chunk) >= 0).select(*dict.fromkeys([*part, *order, "_e", "_r"]))
        types = dict(df.dtypes)
        schema = ", ".join([f"`{c}` {types[c]}" for c in part] + ["_map array<bigint>"])
        maps = spread(slim, part).groupBy(*part).applyInPandas(effect, schema)
        earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        chain = F.aggregate(
            F.collect_list("_map").over(earlier), F.lit(0).cast("bigint"), lambda s, m: F.element_at(m, (s + 1).cast("int"))
        )
        starts = durable(maps.select(*part, chain.alias("_from")))  # one row per chunk of a hot key
        df = join_on(df, F.broadcast(starts), part).withColumn("_from", F.coalesce("_from", F.lit(0)))
    else:
        df = df.withColumn("_from", F.lit(0).cast("bigint"))
    fields = [f for f in df.schema.fields if f.name not in ("_e", "_r", "_from")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["alarm boolean"])
    return numbered(df, part, order).mapInPandas(run, schema)
