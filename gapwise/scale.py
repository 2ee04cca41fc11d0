"""Skew-safe building blocks shared by every operator.

Two problems keep coming back when event tables grow:

* an ordered computation (previous row, running total, last seen value) over a
  key that owns a large share of all rows would run in a single task;
* an exact order statistic over a large group would gather that group.

``scan`` solves the first: a key with more than ``gapwise.hot.rows`` rows is
cut into consecutive chunks of its ordering column, windows run per
``(key, chunk)``, and one summary row per chunk carries the state across the
cuts.  Every supported state is associative, so the result equals the one
window over the whole key, wherever the cuts fall.

``ranked`` and ``quantiles`` solve the second: equal values collapse to one
weighted row, and ranks are running sums computed by ``scan``.

The plan depends on the rows of a key alone, never on the size of the input.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: settings and their defaults; override with ``spark.conf.set``
SETTINGS = {
    "gapwise.hot.rows": 500_000,  # rows of one key that one task may hold
}


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(SETTINGS[name])))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gapwise-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder.

    Lost executors lose nothing, the work above is done once, and the optimizer
    knows the true size of what follows.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/gapwise/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches NULL keys and keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Add per-key statistics to rows; with no keys, a one-row table as scalars."""
    if keys:
        return join_on(df, stats, keys, how)
    one = stats.select(F.struct(*stats.columns).alias("_s")).scalar()
    return df.withColumn("_s", one).select("*", "_s.*").drop("_s")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle by key over all shuffle partitions before per-group Python work.

    Adaptive execution merges partitions by bytes, and a few bytes may be a lot
    of fitting; a numbered repartition is left as it is.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


# --------------------------------------------------------------------------- chunks


def chunk_column(keys: Sequence[str], order: str) -> str:
    """Name of the chunk column; another first key or order has another one."""
    return "_".join(["_chunk", *keys[:1], "by", order])


def _cut_by(df: DataFrame, name: str) -> list[str] | None:
    """Keys for which the chunk column was made, if there is one."""
    return df.schema[name].metadata.get("keys") if name in df.columns else None


def is_cut(df: DataFrame, keys: Sequence[str], order: str) -> bool:
    """Whether keys of ``df`` are spread over chunks of ``order``."""
    name = chunk_column(keys, order)
    return name in df.columns and not df.schema[name].metadata.get("whole", False)


def split(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add the chunk column: -1 for rows of keys that are not cut.

    Rows of keys above ``gapwise.hot.rows`` are range-partitioned once by key and
    ``order`` into tasks of about that many rows, and that copy is kept; the number
    of the task is the chunk.  There is no limit on the chunks of a key.  Hot keys
    are at most rows / hot.rows, which bounds their list and its broadcast.  Without
    hot keys the column is only a note that the check was done for these keys.

    All ``keys`` count: rows that share only the first ones stay with their own key,
    so at most two keys a cut lie on both sides of it.
    """
    keys = list(keys)
    name = chunk_column(keys, order)
    done = _cut_by(df, name)
    if done is not None and (done == keys or (not is_cut(df, keys, order) and done == keys[: len(done)])):
        return df
    df = df.drop(name)
    spark = df.sparkSession
    hot_rows = setting(spark, "gapwise.hot.rows")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    found = sizes.collect()
    if not found:
        return df.withColumn(name, F.lit(-1).alias(name, metadata={"whole": True, "keys": keys}))
    heavy, light, note = df, None, {"whole": False, "keys": keys}
    if keys:
        marked = F.broadcast(spark.createDataFrame(found, sizes.schema).select(*keys))
        heavy, light = join_on(df, marked, keys, "left_semi"), join_on(df, marked, keys, "left_anti")
    parts = -(-sum(r["_n"] for r in found) // hot_rows)
    heavy = heavy.repartitionByRange(parts, *keys, order)
    heavy = durable(heavy.withColumn(name, F.spark_partition_id().alias(name, metadata=note)))
    return heavy if light is None else light.withColumn(name, F.lit(-1).alias(name, metadata=note)).unionByName(heavy)


# --------------------------------------------------------------------------- scan


@dataclass(frozen=True)
class Step:
    kind: str
    expr: Column
    inclusive: bool = True
    n: int = 0


def _col(e: Column | str | int | float) -> Column:
    if isinstance(e, Column):
        return e
    return F.col(e) if isinstance(e, str) else F.lit(e)


def previous(e) -> Step:
    """Value on the previous row of the key."""
    return Step("previous", _col(e))


def running_sum(e, inclusive: bool = True) -> Step:
    return Step("sum", _col(e), inclusive)


def running_max(e, inclusive: bool = True) -> Step:
    return Step("max", _col(e), inclusive)


def last_seen(e, inclusive: bool = False) -> Step:
    """Last non-null value on earlier rows (or up to this row)."""
    return Step("fill", _col(e), inclusive)


def first_of(e) -> Step:
    """Value on the first row of the key."""
    return Step("first", _col(e))


def total(e) -> Step:
    """Sum over the whole key, on every row."""
    return Step("total", _col(e))


def trailing(e, n: int, inclusive: bool = False) -> Step:
    """Array of the last ``n`` values before this row (or up to this row)."""
    return Step("tail", _col(e), inclusive, n)


def _local(step: Step, w, whole) -> Column:
    end = 0 if step.inclusive else -1
    upto = w.rowsBetween(Window.unboundedPreceding, end)
    if step.kind == "previous":
        return F.lag(F.struct(step.expr.alias("v"))).over(w)
    if step.kind == "sum":
        return F.sum(step.expr).over(upto)
    if step.kind == "max":
        return F.max(step.expr).over(upto)
    if step.kind == "fill":
        return F.last(step.expr, ignorenulls=True).over(upto)
    if step.kind == "first":
        return F.first(F.struct(step.expr.alias("v"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if step.kind == "total":
        return F.sum(step.expr).over(whole)
    start = -step.n + 1 if step.inclusive else -step.n
    return F.collect_list(F.struct(step.expr.alias("v"))).over(w.rowsBetween(start, end))


def _summary(step: Step, name: str, at_last, at_first, order: Column) -> Column:
    value = F.struct(step.expr.alias("v"))
    if step.kind == "previous":
        return at_last(value, order)
    if step.kind in ("sum", "total"):
        return F.sum(step.expr)
    if step.kind == "max":
        return F.max(step.expr)
    if step.kind == "fill":
        return at_last(step.expr, F.when(step.expr.isNotNull(), order))
    if step.kind == "first":
        return at_first(value, order)
    return at_last(F.col(f"{name}_t"), order)


def _carried(step: Step, name: str, w) -> Column:
    s, before = F.col(name), w.rowsBetween(Window.unboundedPreceding, -1)
    if step.kind == "previous":
        return F.lag(s).over(w)
    if step.kind == "sum":
        return F.sum(s).over(before)
    if step.kind == "max":
        return F.max(s).over(before)
    if step.kind == "fill":
        return F.last(s, ignorenulls=True).over(before)
    if step.kind == "first":
        return F.first(s).over(before)
    if step.kind == "total":
        return F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    joined = F.flatten(F.collect_list(s).over(w.rowsBetween(-step.n, -1)))
    return F.slice(joined, F.greatest(F.size(joined) - step.n + 1, F.lit(1)), step.n)


def _combined(step: Step, here: Column, carry: Column, first_row: Column) -> Column:
    if step.kind == "previous":
        return F.when(first_row, carry).otherwise(here)["v"]
    if step.kind == "sum":
        return F.when(carry.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + carry)
    if step.kind == "max":
        return F.greatest(here, carry)
    if step.kind in ("fill",):
        return F.coalesce(here, carry)
    if step.kind == "first":
        return F.coalesce(carry, here)["v"]
    if step.kind == "total":
        return F.coalesce(carry, here)
    room = F.lit(step.n) - F.size(here)
    old = F.slice(carry, F.greatest(F.size(carry) - room + 1, F.lit(1)), room)
    return F.transform(F.when(carry.isNull(), here).otherwise(F.concat(old, here)), lambda x: x["v"])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    steps: Mapping[str, Step],
    reverse: bool = False,
) -> DataFrame:
    """Add one column per step, evaluated along ``order`` inside ``keys``.

    With ``reverse`` the rows are walked from last to first, so ``previous`` is
    the next row and ``last_seen`` the next non-null value.
    """
    keys, order = list(keys), list(order)
    df = split(df, keys, order[0])
    chunk = chunk_column(keys, order[0])
    cut = is_cut(df, keys, order[0])
    part = keys + ([chunk] if cut else [])
    by = [F.desc(c) if reverse else F.asc(c) for c in order]
    w = Window.partitionBy(*part).orderBy(*by)
    whole = Window.partitionBy(*part)
    hidden = {name: f"_s{i}" for i, name in enumerate(steps)}
    if not cut:
        out = df.select("*", *[_local(s, w, whole).alias(hidden[n]) for n, s in steps.items()])
        done = []
        for n, s in steps.items():
            here = F.col(hidden[n])
            if s.kind in ("previous", "first"):
                here = here["v"]
            elif s.kind == "tail":
                here = F.transform(here, lambda x: x["v"])
            done.append(here.alias(n))
        return out.select(*[c for c in df.columns if c not in steps], *done)

    cols = [_local(s, w, whole).alias(hidden[n]) for n, s in steps.items()]
    for n, s in steps.items():
        if s.kind == "tail":
            cols.append(_local(Step("tail", s.expr, True, s.n), w, whole).alias(f"{hidden[n]}_t"))
    local = df.select("*", *cols, F.row_number().over(w).alias("_rn"))
    place = F.struct(*order)
    at_last, at_first = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
    sums = (
        local.where(F.col(chunk) >= 0)
        .groupBy(*part)
        .agg(*[_summary(s, hidden[n], at_last, at_first, place).alias(hidden[n]) for n, s in steps.items()])
    )
    w2 = Window.partitionBy(*keys).orderBy(F.desc(chunk) if reverse else F.asc(chunk))
    others = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    carry = (
        sums.select(
            *part,
            *[_carried(s, hidden[n], w2).alias(f"{hidden[n]}_c") for n, s in steps.items()],
            others.alias("_k"),
        )
        .where(F.col("_k") > 1)  # only keys that really span a cut: at most two per cut
        .drop("_k")
    )
    carry = durable(carry)  # kept, so that chained scans do not repeat each other's work
    out = join_on(local, F.broadcast(carry), part)
    return out.select(
        *[c for c in df.columns if c not in steps],
        *[
            _combined(s, F.col(hidden[n]), F.col(f"{hidden[n]}_c"), F.col("_rn") == 1).alias(n)
            for n, s in steps.items()
        ],
    )


# --------------------------------------------------------------------------- ranks


def weighted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lossless compression of a group's values to ``(value, n)``."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def ranked(wv: DataFrame, keys: Sequence[str], value: str, weight: str = "n") -> DataFrame:
    """Add ``upto`` (rows with value <= this) and ``total`` to weighted values.

    They are written once, as checks and cuts read them several times.
    """
    return scan(durable(wv), keys, [value], {"upto": running_sum(weight), "total": total(weight)})


def _at_rank(value: str, rank: Column) -> Column:
    """Value at a 0-based rank, from ranked weighted values."""
    return F.min(F.when(F.col("upto") > rank, F.col(value)))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Mapping[str, float],
    rule: str = "r7",
    size: str | None = None,
) -> DataFrame:
    """Exact quantiles per key, with the number of values as column ``size``.

    ``r7`` interpolates linearly at (n-1)p.  ``simple`` takes the value at
    ceil(np), and for whole np the midpoint with the next value when n is even,
    else the next value.
    """
    keys = list(keys)
    table = ranked(weighted(df, keys, value), keys, value)
    return table_quantiles(table, keys, value, levels, rule, size)


def table_quantiles(
    table: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Mapping[str, float],
    rule: str = "r7",
    size: str | None = None,
    more: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Quantiles of an already ranked weighted table, and ``more`` aggregates of it by the way."""
    t = F.col("total")
    parts, done = [c.alias(name) for name, c in (more or {}).items()], [F.col(name) for name in more or {}]
    if size:
        parts.append(F.max(t).alias(size))
        done.append(F.col(size))
    for name, p in levels.items():
        pos = (t - 1) * F.lit(float(p)) if rule == "r7" else t * F.lit(float(p))
        if rule == "r7":
            low, high = F.floor(pos), F.ceil(pos)
        else:
            whole_np = pos == F.floor(pos)
            low = F.when(whole_np & (t % 2 == 1), pos).when(whole_np, pos - 1).otherwise(F.ceil(pos) - 1)
            high = F.when(whole_np, pos).otherwise(F.ceil(pos) - 1)
        parts += [
            _at_rank(value, low).alias(f"{name}_lo"),
            _at_rank(value, high).alias(f"{name}_hi"),
            F.max(pos - F.floor(pos)).alias(f"{name}_w"),
        ]
        lo, hi, wt = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_w")
        done.append((lo + wt * (hi - lo) if rule == "r7" else (lo + hi) / 2).alias(name))
    return table.groupBy(*keys).agg(*parts).select(*keys, *done)


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, median absolute deviation and number of values per key."""
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(*keys, value)
    med = quantiles(values, keys, value, {"x_med": 0.5}, size="n")
    off = attach(values, med, keys, "inner").withColumn("_d", F.abs(F.col(value) - F.col("x_med")))
    mad = quantiles(off, keys, "_d", {"x_mad": 0.5})
    return attach(med, mad, keys)


def tiers(df: DataFrame, keys: Sequence[str], levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One copy of each row per level, with the keys outside the level set to NULL."""
    types = dict(df.dtypes)
    copies = [
        F.struct(
            F.lit(name).alias("level"),
            *[(F.col(k) if k in own else F.lit(None).cast(types[k])).alias(k) for k in keys],
        )
        for name, own in levels.items()
    ]
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.explode(F.array(*copies)).alias("_tier"), *rest).select("_tier.*", *rest)


def level_stats(
    df: DataFrame, keys: Sequence[str], levels: Mapping[str, Sequence[str]], value: str
) -> DataFrame:
    """``median_mad`` at several key levels in one pass over the rows."""
    return median_mad(tiers(df, keys, levels), ["level", *keys], value)


def at_least(c: Column, bound: Column | float) -> Column:
    """Larger of both; unlike ``greatest``, NULL stays NULL."""
    b = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.when(c.isNotNull() & b.isNotNull(), F.greatest(c, b))


def at_most(c: Column, bound: Column | float) -> Column:
    """Smaller of both; unlike ``least``, NULL stays NULL."""
    b = bound if isinstance(bound, Column) else F.lit(float(bound))
    return F.when(c.isNotNull() & b.isNotNull(), F.least(c, b))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
