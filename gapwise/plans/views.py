"""The driver's tables seen as the engine's inputs (event log, scores, sequences).

Each view has a DuckDB twin so that registered queries can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import epoch_seconds
from ..operators.ordering import delta_labels
from ..operators.sessions import sessions_by_label

IDLE = 43200.0  # 12 h: about a third of the gaps of the event table exceed it
CLIP = 172800.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold zone-less UTC times
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals; the added zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def as_log(e: DataFrame) -> DataFrame:
    """Event rows in the canonical columns of an access log."""
    kind = F.col("event_type")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    epoch = epoch_seconds(F.col("ts"))
    uid = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("row_index"),
        uid.alias("uid"),
        epoch.alias("epoch_s"),
        F.concat(F.lit("u"), uid, F.lit("-"), F.floor(epoch / IDLE).cast("string")).alias("session_id"),
        kind.alias("event"),
        F.when(kind == "signup", "POST")
        .when(kind == "purchase", "PUT")
        .when(kind == "error", "DELETE")
        .otherwise("GET")
        .alias("method"),
        F.concat(F.lit("/"), kind, F.lit("/"), k.cast("string")).alias("path"),
        F.when(kind == "signup", "AUTH")
        .when(kind.isin("view", "click"), "READ")
        .otherwise("UPDATE")
        .alias("op_category"),
        k.alias("k"),
        F.col("value"),
        F.when(kind == "error", 1).otherwise(0).alias("label"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Event table as an access log in canonical columns."""
    return as_log(table(spark, sf, "events"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same log as a file stream, with the event time for watermarks."""
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    return as_log(rows).withColumn("ts", F.timestamp_micros(F.round(F.col("epoch_s") * 1e6).cast("long")))


EV = """ev AS (
  SELECT event_id AS row_index, CAST(user_id AS VARCHAR) AS uid, epoch_us(ts)/1e6 AS epoch_s,
    'u' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(epoch_us(ts)/1e6/43200.0) AS BIGINT) AS VARCHAR) AS session_id,
    event_type AS event,
    CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
    '/' || event_type || '/' || regexp_extract(props, '([0-9]+)', 1) AS path,
    CASE WHEN event_type = 'signup' THEN 'AUTH' WHEN event_type IN ('view','click') THEN 'READ' ELSE 'UPDATE' END AS op_category,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, value,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM events)"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the time since the user's previous event and its label."""
    return delta_labels(events(spark, sf), ["uid"], epsilon=0.5, epsilon_t=60.0)


GAP = (
    EV
    + """, gap AS (
  SELECT *, CASE WHEN d0 IS NULL OR d0 < 0 THEN NULL ELSE greatest(d0, 0.5) END AS delta_seconds,
    CASE WHEN d0 IS NULL OR d0 < 0 THEN 'initial' WHEN greatest(d0, 0.5) <= 60.0 THEN 'unknown' ELSE 'measured' END AS time_label
  FROM (SELECT *, epoch_s - lag(epoch_s) OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS d0 FROM ev))"""
)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Gap sessions (12 h) of the event table."""
    return sessions_by_label(gaps(spark, sf), threshold=IDLE)


SES = (
    GAP
    + """, ses0 AS (
  SELECT *, sum(CASE WHEN time_label = 'initial' OR (time_label = 'measured' AND delta_seconds > 43200.0) THEN 1 ELSE 0 END)
    OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS UNBOUNDED PRECEDING) AS sn FROM gap),
 ses AS (
  SELECT *, CAST(sn - 1 AS BIGINT) AS session_sequence, uid || ':' || CAST(sn - 1 AS VARCHAR) AS sid,
    row_number() OVER (PARTITION BY uid, sn ORDER BY epoch_s, row_index) - 1 AS session_index,
    first_value(epoch_s) OVER (PARTITION BY uid, sn ORDER BY epoch_s, row_index) AS session_start
  FROM ses0)"""
)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Two detector scores with labels: value, and how unusual the gap is for the user."""
    g = gaps(spark, sf)
    return g.select(
        "row_index",
        "uid",
        "session_id",
        "epoch_s",
        "label",
        F.round(F.col("value") / 100, 4).alias("score_a"),
        F.round(F.ln(1 + F.coalesce("delta_seconds", F.lit(0.0))) / 4, 2).alias("score_b"),
    )


SCO = (
    GAP
    + """, sco AS (
  SELECT row_index, uid, session_id, epoch_s, label, round(value / 100, 4) AS score_a,
    round(ln(1 + coalesce(delta_seconds, 0.0)) / 4, 2) AS score_b FROM gap)"""
)
