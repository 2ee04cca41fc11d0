"""Row counts and content digests of inputs, and the fold guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row_hash(columns: Sequence[str]) -> Column:
    """Digest of a row: each value with its length, NULL unlike any text."""
    text = [F.col(c).cast("string") for c in sorted(columns)]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _sum_of(hash_col: str, start: int) -> Column:
    """Sum of 32-bit parts, modulo 2^63, so that no number of rows overflows it."""
    part = F.conv(F.substring(hash_col, start, 8), 16, 10).cast("decimal(38,0)")
    return (F.sum(part) % F.lit(str(2**63)).cast("decimal(38,0)")).cast("long")


def source_manifest(df: DataFrame, source: str, columns: Sequence[str]) -> DataFrame:
    """Row count and order-independent digest per source (file name or id)."""
    h = df.select(F.col(source).alias("source"), _row_hash(columns).alias("_h"))
    return h.groupBy("source").agg(
        F.count(F.lit(1)).alias("row_count"), _sum_of("_h", 1).alias("part1"), _sum_of("_h", 9).alias("part2")
    )


def with_source(df: DataFrame) -> DataFrame:
    """Name of the file each row was read from."""
    return df.withColumn("source", F.col("_metadata.file_path"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """One-row digest over sorted columns, independent of row order."""
    h = df.select(_row_hash(df.columns).alias("_h"))
    return h.agg(
        F.count(F.lit(1)).alias("row_count"), _sum_of("_h", 1).alias("part1"), _sum_of("_h", 9).alias("part2")
    )


def assert_same_manifest(fitted: DataFrame, used: DataFrame) -> None:
    """Refuse statistics fitted on other sources, rows or content."""
    cols = ["source", "row_count", "part1", "part2"]
    a, b = fitted.select(cols), used.select(cols)
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise ValueError("statistics were fitted on different training sources")


def assert_same_fold(fitted_fold: str, fold: str) -> None:
    if fitted_fold != fold:
        raise ValueError(f"statistics belong to fold {fitted_fold}, not {fold}")
