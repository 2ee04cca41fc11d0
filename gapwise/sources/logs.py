"""Scans of event logs and feature files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.contract import LOG_COLUMNS
from ..scale import durable


def read_log_csv(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = LOG_COLUMNS, strict: bool = True
) -> DataFrame:
    """Contract CSV files as text columns with a ``row_index``.

    Column names come from the header of the files; a missing contract column is
    an error.  Rows are numbered before validation, so rejected rows keep their
    number.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .option("mode", "PERMISSIVE")
        .csv(sorted(set(paths)))
    )
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise ValueError(f"missing columns: {missing}")
    return number_rows(df)


def number_rows(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of each row in the input: file name, block, place in the block.

    Tasks read blocks in any order, and two readings may be split differently, so
    the rows are read once, with a provisional number, and written; the numbers are
    made from that copy.  Row counts per block are one row per file split.
    """
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = durable(df.select("*", *where).withColumn("_id", F.monotonically_increasing_id()))
    # the provisional numbers of a block are consecutive: one task reads it
    blocks = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = durable(blocks.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")))
    return rows.join(starts, ["_file", "_block"]).withColumn(name, F.col("_shift") + F.col("_id")).select(*df.columns, name)


def read_events(
    spark: SparkSession, paths: Sequence[str], schema: str | None = None, where: Column | None = None
) -> DataFrame:
    """S3: CSV, JSON lines or Parquet by extension, combined by column name.

    ``where`` (X3) is applied to every part, so it reaches the scan.
    """
    parts = []
    for kind, endings in {"csv": (".csv",), "json": (".json", ".jsonl"), "parquet": (".parquet",)}.items():
        chosen = sorted({p for p in paths if p.lower().endswith(endings)})
        if not chosen:
            continue
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        if schema:
            reader = reader.schema(schema)
        part = reader.format(kind).load(chosen)
        parts.append(part.where(where) if where is not None else part)
    if not parts:
        raise ValueError("no csv, json or parquet paths given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_processed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The Parquet form of a processed table if present, else its CSV form."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        return spark.read.schema(schema).parquet(f"{folder}/events.parquet")
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/events.csv")


def numeric_deltas(
    df: DataFrame, delta: str = "dt_sec", user: str = "uid", category: str = "op_category", optional: Sequence[str] = ()
) -> DataFrame:
    """Rows with a numeric delta, user and category; optional columns as numbers."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in [delta, *optional]})
    filled = (F.coalesce(F.col(user), F.lit("")) != "") & (F.coalesce(F.col(category), F.lit("")) != "")
    return out.where(F.col(delta).isNotNull() & ~F.isnan(delta) & filled)
