"""Streaming operators run over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import online as N
from ..scale import durable, median_mad
from ..streaming import metrics as M
from ..streaming import stateful as T
from ..streaming.runner import in_turns, run_available
from .contract_queries import SECRET, _hmac_sql
from .registry import query
from .session_queries import _A4, _ARR, _marks_sql
from .views import CLIP, EV, GAP, IDLE, event_stream, gaps, r6


def _cols(*names):
    return [r6(n).alias(n) for n in names]


_TOWARD = "{now} + least(greatest(abs({now}), {scale}, 1e-12)*0.1, greatest(-greatest(abs({now}), {scale}, 1e-12)*0.1, {target}-{now}))"
_KEPT = "least(w.med+3.0*greatest(w.smad,1e-12), greatest(w.med-3.0*greatest(w.smad,1e-12), t.x))"
_NEW_MED = _TOWARD.format(now="w.med", scale="greatest(w.smad,1e-12)", target=f"(0.95*w.med+0.05*{_KEPT})")
_NEW_SMAD = _TOWARD.format(now="greatest(w.smad,1e-12)", scale="greatest(w.smad,1e-12)", target=f"(0.95*greatest(w.smad,1e-12)+0.05*greatest(abs({_KEPT}-({_NEW_MED})),1e-12))")


@query("a7_running_stats", f"""WITH RECURSIVE {GAP}, g AS (SELECT uid, epoch_s, row_index, ln(delta_seconds) AS x FROM gap WHERE delta_seconds IS NOT NULL), m AS (SELECT uid, quantile_cont(x,0.5) AS med FROM g GROUP BY uid),
  s AS (SELECT uid, any_value(med) AS med, quantile_cont(abs(x-med),0.5)*1.4826 AS smad FROM g JOIN m USING (uid) GROUP BY uid), t AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS no FROM g),
  w AS (SELECT uid, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS row_index, med, smad FROM s UNION ALL SELECT t.uid, t.no, t.row_index, {_NEW_MED}, greatest(1e-12, {_NEW_SMAD}) FROM w JOIN t ON t.uid=w.uid AND t.no=w.no+1)
  SELECT row_index, round(med,6)+0.0 AS x_med, round(smad,6)+0.0 AS x_smad FROM w WHERE no>0""")
def _(spark, sf):
    g = gaps(spark, sf).where("delta_seconds IS NOT NULL").withColumn("x", F.ln("delta_seconds"))
    start = median_mad(g, ["uid"], "x").withColumn("x_smad", F.col("x_mad") * 1.4826)
    rows = g.select("uid", "epoch_s", "row_index", "x")
    return N.running_stats(rows, start, ["uid"], ["epoch_s", "row_index"], "x").select("row_index", *_cols("x_med", "x_smad"))


@query("st1_stream_sessions", f"""WITH {_ARR} SELECT row_index, split_reason, CAST(ss AS BIGINT) AS session_sequence, si AS session_index,
  round(CASE WHEN split_reason='continuous' THEN d END,6)+0.0 AS delta_seconds, {_hmac_sql("uid || '|' || CAST(CAST(floor(st) AS BIGINT) AS VARCHAR) || '|otsu+kneedle-v1'")} AS generated_session_id FROM a4""")
def _(spark, sf):
    e = event_stream(spark, sf)
    t = F.when(F.col("k") % 20 == 0, F.col("epoch_s") - 200000.0).otherwise(F.col("epoch_s"))
    rows = e.select("uid", "session_id", t.alias("epoch_s"), "row_index")
    out = run_available(T.stream_sessions(rows, idle=IDLE, key=SECRET))
    return out.select("row_index", "split_reason", "session_sequence", "session_index", *_cols("delta_seconds"), "generated_session_id")


@query("st1_closed_sessions", f"""WITH {EV}, t AS (SELECT *, epoch_s-lag(epoch_s) OVER (PARTITION BY uid ORDER BY epoch_s,row_index) AS d FROM ev), s AS (SELECT *, sum(CASE WHEN d IS NULL OR d>43200 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY epoch_s,row_index ROWS UNBOUNDED PRECEDING) AS sn FROM t)
  SELECT uid, count(*) AS events, min(epoch_s) AS first_s, max(epoch_s) AS last_s FROM s GROUP BY uid, sn HAVING max(epoch_s)+43200 <= (SELECT max(epoch_s) FROM ev)-3600""")
def _(spark, sf):
    out = run_available(T.closed_sessions(event_stream(spark, sf), "12 hours", "1 hour"))
    return out.select("uid", "events", (F.unix_micros("first_ts") / 1e6).alias("first_s"), (F.unix_micros("last_ts") / 1e6).alias("last_s"))


_SF = f"""{EV}, sf0 AS (SELECT *, CASE WHEN d0>=0 THEN greatest(d0,0.5) END AS d, CASE WHEN d0 IS NULL OR d0<0 THEN 'initial' WHEN d0<=60 THEN 'unknown' ELSE 'measured' END AS lb FROM (SELECT *, epoch_s-lag(epoch_s) OVER w AS d0, row_number() OVER w-1 AS seq, first_value(epoch_s) OVER w AS st FROM ev WINDOW w AS (PARTITION BY uid, session_id ORDER BY epoch_s,row_index))),
 sf1 AS (SELECT *, lag(d) OVER w AS pd, lag(lb) OVER w AS pl, count(*) FILTER (lb='measured') OVER (PARTITION BY uid, session_id ORDER BY epoch_s,row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM sf0 WINDOW w AS (PARTITION BY uid, session_id ORDER BY epoch_s,row_index)),
 mv AS (SELECT uid, session_id, least(d,{CLIP}) AS c, row_number() OVER (PARTITION BY uid, session_id ORDER BY epoch_s,row_index) AS no FROM sf0 WHERE lb='measured'),
 mq AS (SELECT a.row_index, quantile_cont(b.c,0.25) q25, quantile_cont(b.c,0.5) q50, quantile_cont(b.c,0.75) q75 FROM sf1 a LEFT JOIN mv b ON b.uid=a.uid AND b.session_id=a.session_id AND b.no<=a.bf AND b.no>a.bf-10 GROUP BY a.row_index)"""


@query("st2_stream_features", f"""WITH {_SF} SELECT row_index, lb AS time_label, round(d,6)+0.0 AS delta_seconds, seq AS session_sequence, round(epoch_s-st,6)+0.0 AS session_elapsed_seconds,
  round(CASE WHEN lb='measured' AND pl='measured' THEN greatest(-5,least(5,ln((pd+0.5)/(d+0.5)))) END,6)+0.0 AS delta_log_burst, round(q25,6)+0.0 AS delta_m25, round(q50,6)+0.0 AS delta_m50, round(q75,6)+0.0 AS delta_m75 FROM sf1 JOIN mq USING (row_index)""")
def _(spark, sf):
    rows = event_stream(spark, sf).select("uid", "session_id", "epoch_s", "row_index")
    out = run_available(T.stream_features(rows, 0.5, 60.0, CLIP))
    return out.select(
        "row_index", "time_label", *_cols("delta_seconds"), "session_sequence",
        *_cols("session_elapsed_seconds", "delta_log_burst", "delta_m25", "delta_m50", "delta_m75"),
    )


@query("st2_frozen_stats", f"""WITH {_SF}{_A4[len(EV):]}, z AS (SELECT row_index, CASE WHEN sf1.d IS NOT NULL THEN (ln(greatest(least(sf1.d,{CLIP}),0.5)+0.5) - CASE WHEN us.uid IS NOT NULL THEN coalesce(uh.m, ghf.m) ELSE ghf.m END)
    / greatest(1.4826 * CASE WHEN us.uid IS NOT NULL THEN coalesce(uh.d, ghf.d) ELSE ghf.d END, 1e-9) END AS z
    FROM sf1 JOIN ghf ON ghf.hour = CAST(floor((sf1.epoch_s % 86400)/3600) AS INTEGER) LEFT JOIN us ON us.uid = sf1.uid LEFT JOIN uh ON uh.uid = sf1.uid AND uh.hour = ghf.hour)
  SELECT row_index, round(CASE WHEN z IS NOT NULL THEN greatest(-5, least(5, z)) END,6)+0.0 AS delta_z_deseas_clipped FROM z""")
def _(spark, sf):
    stats = durable(X.fit_robust_stats(gaps(spark, sf), epsilon=0.5))
    rows = event_stream(spark, sf).select("uid", "session_id", "epoch_s", "row_index")
    out = T.with_frozen_stats(T.stream_features(rows, 0.5, 60.0, CLIP), stats, 0.5)
    return run_available(out).select("row_index", *_cols("delta_z_deseas_clipped"))


@query("st3_stream_scores")
def _(spark, sf):
    from ..operators.tailfit import calibrate

    g = gaps(spark, sf).where("delta_seconds IS NOT NULL").withColumn("log_dt", F.ln("delta_seconds"))
    entries = durable(calibrate(g, ["op_category"], "log_dt").select("op_category", "u", "xi", "beta", "p_ref", "q_star"))
    e = T.stream_features(event_stream(spark, sf).withColumn("session_id", F.col("uid")).select("uid", "session_id", "epoch_s", "row_index", "op_category"), 0.5, 60.0, CLIP)
    # the gaps are written first: one stateful operator per stream keeps the state small
    flat = run_available(e).where("delta_seconds IS NOT NULL").select("row_index", "op_category", "delta_seconds")
    # triggers follow each other by row, so the state function holds the rows of one trigger, not all of an entry
    stream = in_turns(flat, "row_index").withColumn("log_dt", F.ln("delta_seconds")).join(entries, "op_category").withColumn("entry", F.col("op_category"))
    keep = ["entry", "row_index", "delta_seconds", "log_dt", "u", "xi", "beta", "p_ref", "q_star"]
    out = run_available(T.stream_scores(stream.select(*keep), every=1000, min_tail=20))
    return out.select("row_index", "entry", "s_evt", "alarm", "refit")


@query("st4_stream_latch", _marks_sql(4, "votes>=3", "value/40 <= 1/1.1"))
def _(spark, sf):
    e = event_stream(spark, sf)
    rows = e.select("uid", "epoch_s", "row_index", (F.col("value") > 40).alias("flag"), (F.col("value") / 40).alias("s"))
    out = run_available(T.stream_ratio_latch(rows, ["uid"], ["epoch_s", "row_index"], "flag", "s", 3, 5, 1.1))
    return out.select("row_index", "votes", "alarm")


@query("st5_closed_session_rows", f"""WITH {EV}, l AS (SELECT uid, arg_max(session_id, epoch_s) AS last_sid, max(epoch_s) AS last_t FROM ev GROUP BY uid)
  SELECT row_index, session_id FROM ev JOIN l USING (uid) WHERE session_id<>last_sid OR last_t+7200 < (SELECT max(epoch_s) FROM ev)""")
def _(spark, sf):
    rows = event_stream(spark, sf).select("uid", "session_id", "epoch_s", "row_index", "ts")
    out = run_available(T.stream_closed_session_rows(rows, "uid", "session_id", ["epoch_s", "row_index"], 7200.0))
    return out.select("row_index", "session_id")


@query("st6_alarm_metrics", f"""WITH {GAP}, w AS (SELECT CAST(floor(epoch_s/86400)*86400 AS BIGINT) AS window_start_s, k FROM gap) SELECT window_start_s, count(*) AS rows, count(*) FILTER (k>80) AS alarms, round(count(*) FILTER (k%10=0)/count(*),6)+0.0 AS unknown_share FROM w GROUP BY 1 HAVING window_start_s+86400 <= (SELECT max(epoch_s) FROM ev)-600""")
def _(spark, sf):
    e = event_stream(spark, sf)
    rows = e.select("ts", (F.col("k") > 80).alias("alarm"), F.when(F.col("k") % 10 == 0, "unknown").otherwise("measured").alias("time_label"))
    out = run_available(M.alarm_metrics(rows, "1 day", "10 minutes"))
    return out.withColumn("unknown_share", r6("unknown_share"))
