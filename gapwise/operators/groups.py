"""Ordered rows of each group handed to a callback."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import spread

Frames = Iterator[pd.DataFrame]


def _changes(own: pd.DataFrame) -> np.ndarray:
    """Whether a row has another key than the row before; missing key values are equal to each other."""
    before = own.shift()
    return ((own != before) & ~(own.isna() & before.isna())).any(axis=1).to_numpy(dtype=bool, copy=True)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key in one partition, sorted by key and ``order``, missing values last, ``_no`` counting from 1 in each key.

    Python code that walks the partition finds the first rows of keys by ``_no`` and need not look at the keys.
    """
    by = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    return (spread(df, keys) if keys else df).withColumn("_no", F.row_number().over(by))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of a sorted partition cut where groups begin (``_no`` is 1), with the places of these rows."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        return table, np.flatnonzero(table.column("_no").to_numpy() == 1)

    for batch in batches:
        new = np.flatnonzero(batch.column(batch.schema.get_field_index("_no")).to_numpy() == 1)
        if len(new):
            last = int(new[-1])
            if last:
                held.append(batch.slice(0, last))
            if held:
                yield joined()
            held = []
            batch = batch.slice(last)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield joined()


def _runs(frames: Frames, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Cut frames where a key changes; missing key values are equal to each other."""
    for frame in frames:
        own = frame[keys]
        starts = [*_changes(own).nonzero()[0].tolist(), len(frame)]
        starts = starts if starts[0] == 0 else [0, *starts]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a < b:
                key = tuple(None if pd.isna(v) else v for v in own.iloc[a])
                yield key, frame.iloc[a:b].reset_index(drop=True)


def for_each_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    callback: Callable[[tuple, Frames], Frames],
    schema: str | T.StructType,
) -> DataFrame:
    """Call ``callback(key, frames)`` once per group and return the frames that it yields.

    ``frames`` are the rows of the group in ``order``, in pieces of at most an Arrow batch, read from the sorted partition
    as the callback asks for them.  What it keeps in local variables is the state that crosses pieces, so a group of any
    size needs the memory of one piece and of that state.  Null keys form one group; frames that the callback leaves are
    skipped; rows of one place in ``order`` come in any order.  An empty table makes no call.

    A group is one stream through one task, as a callback may depend on all earlier rows.  State that can be merged belongs
    in ``scale.scan``, which cuts hot keys.
    """
    keys, order = list(keys), list(order)

    def walk(frames: Frames) -> Frames:
        runs = _runs(frames, keys)
        ahead = next(runs, None)

        def rows_of(key: tuple) -> Frames:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                frame, ahead = ahead[1], None
                yield frame
                ahead = next(runs, None)

        while ahead is not None:
            key = ahead[0]
            rows = rows_of(key)
            yield from callback(key, rows)
            for _ in rows:
                pass

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)
