"""ST6: rolling counts of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alarm_metrics(df: DataFrame, width: str = "1 hour", delay: str = "10 minutes", ts: str = "ts", alarm: str = "alarm", label: str = "time_label") -> DataFrame:
    """Rows, alarms and label shares per tumbling window behind a watermark."""
    n = F.count(F.lit(1))
    return (
        df.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(
            n.alias("rows"),
            F.count_if(F.col(alarm)).alias("alarms"),
            (F.count_if(F.col(label) == "unknown") / n).alias("unknown_share"),
        )
        .select(F.unix_seconds("w.start").alias("window_start_s"), "rows", "alarms", "unknown_share")
    )
