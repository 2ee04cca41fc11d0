"""Sources and sinks: the log is written in each form and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sql as X
from ..operators import contract as C
from ..operators import features as W
from ..operators import statistics as T
from ..operators.sessions import sessions_by_label
from ..scale import attach, shared_folder
from ..sources import logs, provenance, sinks
from .contract_queries import _REASON, RAW, SECRET, _hmac_sql, raw_log
from .registry import query
from .session_queries import _A4
from .views import EV, GAP, IDLE, SES, events, gaps, r6


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/gapwise/files-{uuid.uuid4().hex}"


def _csv(spark, sf, parts: int = 3) -> str:
    """Raw log as CSV files, one per range of rows."""
    path = _folder(spark)
    raw = raw_log(spark, sf).withColumnRenamed("row_index", "line").drop("status_code")
    for i in range(parts):
        sinks.write_table(raw.where(F.col("line") % parts == i), f"{path}/p{i}", "csv")
    return path


# an empty CSV cell reads as NULL, and blanks around values are trimmed
_CSV_RAW = RAW + """, csv AS (SELECT row_index, nullif(trim(timestamp_utc),'') AS timestamp_utc, nullif(trim(uid),'') AS uid, nullif(trim(session_id),'') AS session_id, nullif(trim(method),'') AS method,
  nullif(trim(path),'') AS path, nullif(trim(referer),'') AS referer, nullif(trim(user_agent),'') AS user_agent, nullif(trim(ip),'') AS ip, nullif(trim(cookie),'') AS cookie, op_category FROM raw)"""


@query("s1_csv_contract_scan", f"WITH {_CSV_RAW} SELECT row_index AS line, {_REASON} AS reason FROM csv")
def _(spark, sf):
    base = _csv(spark, sf, 1)
    df = logs.read_log_csv(spark, f"{base}/p0")
    out = C.check_rows(df)
    return out.select(F.col("line").cast("bigint").alias("line"), "reason")


@query("s2_multi_file_scan", f"WITH {EV} SELECT count(*) AS rows, count(*) AS distinct_index, CAST(count(*)-1 AS BIGINT) AS last_index, CAST(sum(row_index) AS BIGINT) AS line_sum FROM ev")
def _(spark, sf):
    base = _csv(spark, sf)
    # the repeated folder is read once
    df = logs.read_log_csv(spark, [f"{base}/p2", f"{base}/p0", f"{base}/p1", f"{base}/p0"])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("row_index").alias("distinct_index"),
        F.max("row_index").alias("last_index"),
        F.sum(F.col("line").cast("bigint")).alias("line_sum"),
    )


@query("s3_mixed_formats", f"WITH {EV} SELECT row_index, uid, value FROM ev WHERE value>5")
def _(spark, sf):
    base = _folder(spark)
    e = events(spark, sf).select("row_index", "uid", "value", "k")
    sinks.write_table(e.where("row_index % 3 = 0"), f"{base}/a.csv", "csv")
    sinks.write_table(e.where("row_index % 3 = 1"), f"{base}/b.json", "json")
    sinks.write_table(e.where("row_index % 3 = 2"), f"{base}/c.parquet")
    schema = "row_index bigint, uid string, value double, k int"
    df = logs.read_events(spark, [f"{base}/a.csv", f"{base}/b.json", f"{base}/c.parquet"], schema, where=F.col("value") > 5)
    return df.select("row_index", "uid", "value")


@query("s4_processed_scan", f"WITH {EV} SELECT 'csv' AS form, row_index, uid, value AS value FROM ev UNION ALL SELECT 'parquet', row_index, uid, value+1 FROM ev")
def _(spark, sf):
    e = events(spark, sf).select("row_index", "uid", "value")
    a, b = _folder(spark), _folder(spark)
    sinks.write_table(e, f"{a}/events.csv", "csv")
    sinks.write_table(e, f"{b}/events.csv", "csv")
    sinks.write_table(e.withColumn("value", F.col("value") + 1), f"{b}/events.parquet")
    schema = "row_index bigint, uid string, value double"
    one = logs.read_processed(spark, a, schema).withColumn("form", F.lit("csv"))
    two = logs.read_processed(spark, b, schema).withColumn("form", F.lit("parquet"))
    return one.unionByName(two)


@query("s6_feature_sink", f"WITH {GAP} SELECT row_index, uid, round(delta_seconds,6)+0.0 AS delta_seconds, time_label FROM gap")
def _(spark, sf):
    path = _folder(spark)
    g = gaps(spark, sf).select("row_index", "uid", "delta_seconds", "time_label")
    sinks.write_table(g, path, "parquet", by="time_label")
    return spark.read.parquet(path).select("row_index", "uid", r6("delta_seconds").alias("delta_seconds"), "time_label")


@query("s7_audit_sink", f"WITH {EV} SELECT row_index AS row, value, value>50 AS flagged, uid AS meta_uid FROM ev")
def _(spark, sf):
    path = _folder(spark)
    a = events(spark, sf).select(
        F.col("row_index").alias("row"), "value", (F.col("value") > 50).alias("flagged"), F.struct("uid", "op_category").alias("metadata")
    )
    sinks.write_audit(a, path)
    back = spark.read.schema(a.schema).json(path)
    return back.select("row", "value", "flagged", F.col("metadata.uid").alias("meta_uid"))


@query("s8_stats_table", f"WITH {_A4} SELECT uid, hour, round(m,6)+0.0 AS x_med, round(greatest(d*1.4826,1e-12),6)+0.0 AS x_smad FROM (SELECT us.uid, ghf.hour, coalesce(uh.m, ghf.m) AS m, coalesce(uh.d, ghf.d) AS d FROM us CROSS JOIN ghf LEFT JOIN uh ON uh.uid=us.uid AND uh.hour=ghf.hour)")
def _(spark, sf):
    path = _folder(spark)
    sinks.save_stats(W.fit_robust_stats(gaps(spark, sf), epsilon=0.5), path, epsilon=0.5)
    s = sinks.load_stats(spark, path).where("level = 'key' AND hour IS NOT NULL")
    return s.select("uid", "hour", r6("x_med").alias("x_med"), r6("x_smad").alias("x_smad"))


@query("s9_file_manifest", f"WITH {EV} SELECT 'p' || CAST(row_index%3 AS VARCHAR) AS folder, count(*) AS row_count FROM ev GROUP BY 1")
def _(spark, sf):
    base = _csv(spark, sf)
    df = provenance.with_source(spark.read.option("header", True).option("recursiveFileLookup", True).csv(base))
    m = provenance.source_manifest(df, "source", [c for c in df.columns if c != "source"])
    folder = F.regexp_extract("source", r"/(p\d)/", 1)
    return m.groupBy(folder.alias("folder")).agg(F.sum("row_count").alias("row_count"))


@query("x1_custom_session_id", f"WITH {SES} SELECT row_index, 'S-' || uid || '-' || CAST(CAST(floor(session_start) AS BIGINT) AS VARCHAR) AS sid FROM ses")
def _(spark, sf):
    def made():
        return F.concat_ws("-", F.lit("S"), "uid", F.floor("session_start").cast("string"))

    return sessions_by_label(gaps(spark, sf), IDLE, make_sid=made).select("row_index", "sid")


@query("x4_feature_overrides", f"WITH {EV} SELECT row_index, value AS dt_sec, round(ln(value),6)+0.0 AS log_dt, CAST(1.5 AS DOUBLE) AS z, CAST(1.0 AS DOUBLE) AS z_clipped FROM ev")
def _(spark, sf):
    e = events(spark, sf).withColumn("session_id", F.col("uid"))
    f = W.augmented_features(e, epsilon=0.5, bound=1.0, overrides={"dt_sec": F.col("value"), "z": F.lit(1.5)})
    return f.select("row_index", "dt_sec", r6("log_dt").alias("log_dt"), "z", "z_clipped")


@query("x_sql_functions", f"""WITH {EV} SELECT row_index, event || '/{{int}}' AS template, round(CASE WHEN value<=40 THEN 0.1 ELSE 0.1*pow(1+0.15*(value-40)/25.0,-1/0.15) END,6)+0.0 AS p, round(exp(-exp(-3.0)*value),6)+0.0 AS survival, {_hmac_sql('uid')} AS pseudonym FROM ev""")
def _(spark, sf):
    X.register(spark, SECRET)
    e = events(spark, sf)
    return e.select(
        "row_index",
        F.expr("path_template(path)").alias("template"),
        r6(F.expr("tail_probability(value - 40, 0.15D, 25D, 0.1D)")).alias("p"),
        r6(F.expr("gap_survival(-3D, 0D, value)")).alias("survival"),
        F.expr("keyed_hash(uid)").alias("pseudonym"),
    )


@query("a18_next_probability", f"""WITH {EV}, t0 AS (SELECT row_index, event AS target, lag(event) OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS context FROM ev), c AS (SELECT context, target, count(*) AS n FROM t0 WHERE context IS NOT NULL GROUP BY 1,2), s AS (SELECT context, sum(n) AS tot, count(*) AS kinds FROM c GROUP BY context)
  SELECT row_index, round(coalesce(c.n/s.tot, 1/8.0)/CASE WHEN s.kinds IS NULL THEN 1 ELSE 1+(8-s.kinds)/8.0 END,6)+0.0 AS p FROM t0 LEFT JOIN c ON c.context=t0.context AND c.target=t0.target LEFT JOIN s ON s.context=t0.context WHERE t0.context IS NOT NULL""")
def _(spark, sf):
    from ..operators.sequences import next_event_pairs

    e = events(spark, sf)
    pairs = next_event_pairs(e, ["uid"], ["epoch_s", "row_index"])
    t = T.transitions(e, ["uid"], ["epoch_s", "row_index"], "event")
    size = e.agg((F.count_distinct("event") + 3).alias("v"))
    pairs = attach(pairs, size, [])
    return T.next_token_probability(t, pairs, F.col("v"), normalize=True).select("row_index", r6("p").alias("p"))
