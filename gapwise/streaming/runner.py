"""Runs a stream over the data that is there and reads its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import chunk_column, is_cut, setting, shared_folder, split


def run_available(stream: DataFrame, mode: str = "append", form: str = "parquet") -> DataFrame:
    """Process all available input, keeping output and checkpoint in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/gapwise/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format(form)
        .outputMode(mode)
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).format(form).load(f"{base}/out")


def in_turns(rows: DataFrame, order: str) -> DataFrame:
    """Rows as a stream whose triggers hold ``gapwise.hot.rows`` rows at about most, one range of ``order`` after the other.

    A state that needs its rows in order then never meets more of them at once than a trigger has.  Each range is one
    file, written after the file of the range before, as a file stream takes the oldest file first.
    """
    spark = rows.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/gapwise/turns-{uuid.uuid4().hex}"
    cut = split(rows, [], order)
    chunk = chunk_column([], order)
    plain = cut.drop(chunk)
    if not is_cut(cut, [], order):
        plain.coalesce(1).write.parquet(f"{base}/000000")
    else:
        parts = -(-cut.count() // setting(spark, "gapwise.hot.rows"))
        for i in range(parts):
            cut.where(F.col(chunk) == i).drop(chunk).coalesce(1).write.parquet(f"{base}/{i:06d}")
    return spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/*")


def write_audit_stream(stream: DataFrame, path: str, checkpoint: str):
    """S7 as a stream: JSON lines."""
    return (
        stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    )
