"""Queries over order, sessions, latches and features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import features as X
from ..operators import latches as L
from ..operators import ordering as O
from ..operators import protocol as P
from ..operators import sessions as S
from ..operators.groups import for_each_group
from ..scale import at_most, quantiles
from .contract_queries import SECRET, _hmac_sql
from .registry import query
from .views import CLIP, EV, GAP, IDLE, SES, events, gaps, r6, sessions


@query("flagship_top_users", f"""WITH {SES}, st AS (SELECT uid, sid, count(*) AS n, max(epoch_s) - min(epoch_s) AS dur FROM ses GROUP BY uid, sid)
  SELECT uid, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, round(avg(dur),6) AS mean_duration FROM st GROUP BY uid ORDER BY sessions DESC, uid LIMIT 20""")
def _(spark, sf):
    t = S.session_table(sessions(spark, sf), session="sid")
    top = t.groupBy(F.col("group").alias("uid")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("events").alias("events"),
        r6(F.avg("duration")).alias("mean_duration"),
    )
    return top.orderBy(F.desc("sessions"), "uid").limit(20)


_ORD = f"""{EV}, o AS (SELECT uid, floor(epoch_s/7200)*7200 + (k%2)*0.25 AS epoch_s, CASE WHEN k%3=0 THEN NULL ELSE row_index END AS row_index, row_index AS id FROM ev),
  o2 AS (SELECT *, row_number() OVER (PARTITION BY uid, CAST(floor(epoch_s) AS BIGINT), CAST(floor((epoch_s-floor(epoch_s))*1000+0.5) AS INTEGER) ORDER BY row_index NULLS LAST, id) AS rn FROM o)"""


def _rounded(spark, sf):
    e = events(spark, sf)
    return e.select(
        "uid",
        (F.floor(F.col("epoch_s") / 7200) * 7200 + (F.col("k") % 2) * 0.25).alias("epoch_s"),
        F.when(F.col("k") % 3 != 0, F.col("row_index")).alias("row_index"),
    )


@query("w1_strict_order", f"WITH {_ORD} SELECT uid, epoch_s, row_index FROM o2 WHERE rn = 1 OR row_index IS NOT NULL")
def _(spark, sf):
    return O.strict_order(_rounded(spark, sf)).select("uid", "epoch_s", "row_index")


@query("w2_delta_labels", f"WITH {GAP} SELECT row_index, round(delta_seconds,6)+0.0 AS delta_seconds, time_label FROM gap")
def _(spark, sf):
    return gaps(spark, sf).select("row_index", r6("delta_seconds").alias("delta_seconds"), "time_label")


@query("w3_label_counts", f"""WITH {GAP} SELECT count(*) AS total, count(*) FILTER (time_label='initial') AS initial,
  count(*) FILTER (time_label='measured') AS measured, count(*) FILTER (time_label='unknown') AS unknown FROM gap""")
def _(spark, sf):
    return O.label_counts(gaps(spark, sf))


@query("w4_sessions_by_label", f"WITH {SES} SELECT row_index, sid, session_sequence, session_index, session_start FROM ses")
def _(spark, sf):
    return sessions(spark, sf).select("row_index", "sid", "session_sequence", "session_index", "session_start")


_ARR = f"""{EV}, arr AS (SELECT uid, session_id, CASE WHEN k%20=0 THEN epoch_s - 200000.0 ELSE epoch_s END AS epoch_s, row_index FROM ev),
 a1 AS (SELECT *, epoch_s - lag(epoch_s) OVER w AS d, lag(session_id) OVER w AS ps FROM arr WINDOW w AS (PARTITION BY uid ORDER BY row_index)),
 a2 AS (SELECT *, CASE WHEN d IS NULL THEN 'initial' WHEN d < 0 THEN 'timestamp_regression' WHEN d > 43200.0 THEN 'idle_timeout'
   WHEN session_id <> ps THEN 'session_id_change' ELSE 'continuous' END AS split_reason FROM a1),
 a3 AS (SELECT *, sum(CASE WHEN split_reason <> 'continuous' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY row_index ROWS UNBOUNDED PRECEDING) - 1 AS ss FROM a2),
 a4 AS (SELECT *, row_number() OVER (PARTITION BY uid, ss ORDER BY row_index) - 1 AS si, first_value(epoch_s) OVER (PARTITION BY uid, ss ORDER BY row_index) AS st FROM a3)"""


def _arrival(spark, sf):
    e = events(spark, sf)
    t = F.when(F.col("k") % 20 == 0, F.col("epoch_s") - 200000.0).otherwise(F.col("epoch_s"))
    return e.select("uid", "session_id", t.alias("epoch_s"), "row_index")


@query("w5_sessions_arrival", f"""WITH {_ARR} SELECT row_index, split_reason, CAST(ss AS BIGINT) AS session_sequence, si AS session_index,
  round(CASE WHEN split_reason='continuous' THEN d END,6)+0.0 AS delta_seconds, {_hmac_sql("uid || '|' || CAST(CAST(floor(st) AS BIGINT) AS VARCHAR) || '|otsu+kneedle-v1'")} AS generated_session_id FROM a4""")
def _(spark, sf):
    out = S.sessions_in_arrival_order(_arrival(spark, sf), idle=IDLE, key=SECRET)
    return out.select(
        "row_index", "split_reason", "session_sequence", "session_index",
        r6("delta_seconds").alias("delta_seconds"), "generated_session_id",
    )


@query("w6_sessions_given", f"""WITH {EV} SELECT row_index, session_id, round(greatest(coalesce(epoch_s - lag(epoch_s) OVER (PARTITION BY session_id ORDER BY epoch_s, row_index),0.0),0.0),6)+0.0 AS delta_t FROM ev""")
def _(spark, sf):
    out = S.sessions_given_or_idle(events(spark, sf), IDLE, given=True)
    return out.select("row_index", "session_id", r6("delta_t").alias("delta_t"))


@query("w6_sessions_idle", f"""WITH {EV}, t AS (SELECT *, epoch_s - lag(epoch_s) OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS d FROM ev)
  SELECT row_index, last_value(CASE WHEN d IS NULL OR d > 43200.0 THEN uid || '-' || CAST(CAST(round(epoch_s*1e6) AS BIGINT)*1000 AS VARCHAR) END IGNORE NULLS)
     OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS UNBOUNDED PRECEDING) AS session_id,
   round(CASE WHEN d IS NULL OR d > 43200.0 THEN 0.0 ELSE d END,6)+0.0 AS delta_t FROM t""")
def _(spark, sf):
    out = S.sessions_given_or_idle(events(spark, sf), IDLE, given=False)
    return out.select("row_index", "session_id", r6("delta_t").alias("delta_t"))


@query("w7_sessions_user_threshold", f"""WITH {GAP}, th AS (SELECT uid, quantile_cont(delta_seconds, 0.75) AS tau FROM gap GROUP BY uid),
  t AS (SELECT row_index, uid, epoch_s, CASE WHEN delta_seconds IS NULL OR delta_seconds >= tau THEN 1 ELSE 0 END AS st FROM gap JOIN th USING (uid))
  SELECT row_index, CAST(sum(st) OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session_sequence FROM t""")
def _(spark, sf):
    g = gaps(spark, sf)
    tau = quantiles(g, ["uid"], "delta_seconds", {"tau": 0.75})
    return S.sessions_by_user_threshold(g, tau).select("row_index", "session_sequence")


@query("w8_sessions_counter", f"""WITH {EV}, t AS (SELECT *, epoch_s - lag(epoch_s) OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS d FROM ev)
  SELECT row_index, uid || '_' || CAST(sum(CASE WHEN d IS NULL OR d > 86400.0 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS session_label FROM t""")
def _(spark, sf):
    return S.sessions_by_counter(events(spark, sf), 86400.0).select("row_index", "session_label")


_FEAT = f"""{SES}, f0 AS (SELECT row_index, uid, sid, epoch_s, session_index AS seq, session_start, delta_seconds, time_label,
    CASE WHEN delta_seconds IS NOT NULL THEN least(delta_seconds, {CLIP}) END AS clipped, lag(time_label) OVER w AS pl, lag(delta_seconds) OVER w AS pd, lag(session_index) OVER w AS pseq
  FROM ses WINDOW w AS (PARTITION BY uid, sid ORDER BY epoch_s, row_index))"""


def _by_gap_session(spark, sf):
    return sessions(spark, sf).drop("session_id", "session_sequence", "session_index").withColumnRenamed("sid", "session_id")


def _feature_rows(spark, sf):
    return X.gap_features(_by_gap_session(spark, sf), epsilon=0.5, clip_seconds=CLIP, window=4)


@query("w9_rolling_quantiles", f"""WITH {_FEAT}, m AS (SELECT *, count(*) FILTER (time_label='measured') OVER (PARTITION BY uid, sid ORDER BY epoch_s, row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f0),
  mm AS (SELECT uid, sid, clipped, row_number() OVER (PARTITION BY uid, sid ORDER BY epoch_s, row_index) AS no FROM f0 WHERE time_label='measured')
  SELECT a.row_index, round(quantile_cont(b.clipped,0.25),6)+0.0 AS delta_m25, round(quantile_cont(b.clipped,0.5),6)+0.0 AS delta_m50, round(quantile_cont(b.clipped,0.75),6)+0.0 AS delta_m75
  FROM m a LEFT JOIN mm b ON a.uid=b.uid AND a.sid=b.sid AND b.no <= a.before AND b.no > a.before - 4 GROUP BY a.row_index""")
def _(spark, sf):
    f = _feature_rows(spark, sf)
    return f.select("row_index", *[r6(c).alias(c) for c in ("delta_m25", "delta_m50", "delta_m75")])


@query("w10_log_burst", f"""WITH {_FEAT} SELECT row_index, round(CASE WHEN time_label='measured' AND seq>0 AND pl='measured' AND pseq>0
   AND pd IS NOT NULL THEN greatest(-5.0, least(5.0, ln((pd+0.5)/(delta_seconds+0.5)))) END,6)+0.0 AS delta_log_burst FROM f0""")
def _(spark, sf):
    return _feature_rows(spark, sf).select("row_index", r6("delta_log_burst").alias("delta_log_burst"))


@query("w11_session_position", f"""WITH {_FEAT} SELECT row_index, seq AS session_sequence, round(greatest(epoch_s-session_start,0.0),6)+0.0 AS session_elapsed_seconds, seq=0 AS is_session_start FROM f0""")
def _(spark, sf):
    f = X.session_position(_by_gap_session(spark, sf))
    return f.select("row_index", "session_sequence", r6("session_elapsed_seconds").alias("session_elapsed_seconds"), "is_session_start")


_AUG = f"""{EV}, g0 AS (SELECT *, epoch_s - lag(epoch_s) OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS d0, floor((epoch_s % 86400)/3600) AS hour FROM ev),
 g AS (SELECT *, CASE WHEN d0>=0 THEN greatest(d0, 0.5) END AS d FROM g0),
 st AS (SELECT avg(d) mean, stddev_pop(d) std, median(d) med, mad(d) mad FROM g), hs AS (SELECT hour, median(d) hmed, mad(d) hmad, stddev_pop(d) hstd FROM g GROUP BY hour),
 z AS (SELECT g.*, (d-mean)/std AS z, CASE WHEN mad>0 THEN 0.6744897501960817*(d-med)/mad ELSE sign(d-med) END AS z_robust,
   CASE WHEN hstd>0 THEN (d-hmed)/hstd WHEN hmad>0 THEN (d-hmed)/(hmad*1.4826) ELSE sign(d-hmed) END AS z_hourly FROM g CROSS JOIN st JOIN hs USING (hour)),
 nn AS (SELECT *, count(d) OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS UNBOUNDED PRECEDING) AS upto FROM z),
 vals AS (SELECT uid, d, row_number() OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS no FROM g WHERE d IS NOT NULL),
 tr AS (SELECT a.row_index, quantile_cont(b.d,0.5) q50, quantile_cont(b.d,0.9) q90, avg(ln(b.d)) lm, stddev_pop(ln(b.d)) ls, count(b.d) AS c
   FROM nn a LEFT JOIN vals b ON a.uid=b.uid AND b.no<=a.upto AND b.no>a.upto-12 GROUP BY a.row_index)"""


@query("w12_augmented_features", f"""WITH {_AUG} SELECT row_index, round(d,6)+0.0 AS dt_sec, round(CASE WHEN d IS NOT NULL THEN greatest(-5,least(5,z)) END,6)+0.0 AS z_clipped,
  round(CASE WHEN d IS NOT NULL THEN greatest(-5,least(5,z_robust)) END,6)+0.0 AS z_robust_clipped, round(CASE WHEN d IS NOT NULL THEN greatest(-5,least(5,z_hourly)) END,6)+0.0 AS z_hourly_clipped, round(q50,6)+0.0 AS q50, round(q90,6)+0.0 AS q90,
  round(lm,6)+0.0 AS log_burst_mean, round(CASE WHEN c=1 THEN 0.0 ELSE ls END,6)+0.0 AS log_burst_std,
  round(CASE WHEN d IS NULL THEN NULL WHEN c=1 THEN 0.0 WHEN ls>1e-12 THEN greatest(-5,least(5,(ln(d)-lm)/ls)) ELSE 0.0 END,6)+0.0 AS log_burst_z_clipped FROM nn JOIN tr USING (row_index)""")
def _(spark, sf):
    e = events(spark, sf).withColumn("session_id", F.col("uid"))
    f = X.augmented_features(e, epsilon=0.5)
    cols = [
        "dt_sec", "z_clipped", "z_robust_clipped", "z_hourly_clipped", "q50", "q90",
        "log_burst_mean", "log_burst_std", "log_burst_z_clipped",
    ]
    return f.select("row_index", *[r6(c).alias(c) for c in cols])


_A4 = f"""{GAP}, x AS (SELECT uid, CAST(floor((epoch_s % 86400)/3600) AS INTEGER) AS hour, ln(greatest(delta_seconds,0.5)+0.5) AS x FROM gap WHERE time_label='measured'),
 gl AS (SELECT median(x) m, mad(x) d FROM x), gh AS (SELECT hour, median(x) m, mad(x) d FROM x GROUP BY hour),
 hrs AS (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour), ghf AS (SELECT hrs.hour, coalesce(gh.m,gl.m) m, coalesce(gh.d,gl.d) d FROM hrs CROSS JOIN gl LEFT JOIN gh USING (hour)),
 us AS (SELECT uid, median(x) m, mad(x) d FROM x GROUP BY uid HAVING count(*) >= 8), uh AS (SELECT uid, hour, median(x) m, mad(x) d FROM x GROUP BY uid, hour)"""


@query("a4_robust_fit", f"""WITH {_A4}, r AS (SELECT 'global' AS level, NULL AS uid, NULL::INTEGER AS hour, m, d FROM gl UNION ALL SELECT 'global', NULL, hour, m, d FROM ghf
   UNION ALL SELECT 'key', uid, NULL, m, d FROM us UNION ALL SELECT 'key', us.uid, ghf.hour, coalesce(uh.m, ghf.m), coalesce(uh.d, ghf.d) FROM us CROSS JOIN ghf LEFT JOIN uh ON uh.uid=us.uid AND uh.hour=ghf.hour)
  SELECT level, uid, hour, round(m,6)+0.0 AS x_med, round(d,6)+0.0 AS x_mad, round(d*1.4826,6)+0.0 AS x_smad FROM r""")
def _(spark, sf):
    s = X.fit_robust_stats(gaps(spark, sf), epsilon=0.5)
    return s.select("level", "uid", "hour", *[r6(c).alias(c) for c in ("x_med", "x_mad", "x_smad")])


_A5 = f"""{SES}, b AS (SELECT row_index, uid, sid, CAST(floor((epoch_s % 86400)/3600) AS INTEGER) AS hour, CASE WHEN delta_seconds IS NOT NULL THEN least(delta_seconds,{CLIP}) END AS x,
    CASE WHEN time_label='measured' THEN ln(greatest(least(delta_seconds,{CLIP}),0.5)+0.5) END AS lx FROM ses),
 g AS (SELECT median(x) m, mad(x)*1.4826 s FROM b), lg AS (SELECT median(lx) m, mad(lx)*1.4826 s FROM b),
 u AS (SELECT uid, count(x) n, median(x) m, mad(x)*1.4826 s, count(lx) ln_ FROM b GROUP BY uid), ss AS (SELECT uid, sid, count(x) n, median(x) m, mad(x)*1.4826 s, count(lx) ln_ FROM b GROUP BY uid, sid),
 hg AS (SELECT hour, median(lx) m, mad(lx)*1.4826 s FROM b GROUP BY hour), hu AS (SELECT uid, hour, median(lx) m, mad(lx)*1.4826 s FROM b GROUP BY uid, hour),
 hs AS (SELECT uid, sid, hour, median(lx) m, mad(lx)*1.4826 s FROM b GROUP BY uid, sid, hour),
 j AS (SELECT b.row_index, b.x,
   CASE WHEN ss.n>=4 THEN CASE WHEN ss.s>=1e-9 THEN ss.m ELSE g.m END WHEN u.n>=4 THEN CASE WHEN u.s>=1e-9 THEN u.m ELSE g.m END ELSE g.m END AS zm,
   CASE WHEN ss.n>=4 THEN CASE WHEN ss.s>=1e-9 THEN ss.s ELSE greatest(g.s,1e-9) END WHEN u.n>=4 THEN CASE WHEN u.s>=1e-9 THEN u.s ELSE greatest(g.s,1e-9) END ELSE greatest(g.s,1e-9) END AS zs,
   CASE WHEN ss.ln_>=4 THEN coalesce(hs.m,hg.m,lg.m) WHEN u.ln_>=4 THEN coalesce(hu.m,hg.m,lg.m) ELSE coalesce(hg.m,lg.m) END AS sm,
   CASE WHEN ss.ln_>=4 THEN coalesce(hs.s,hg.s,greatest(lg.s,1e-9)) WHEN u.ln_>=4 THEN coalesce(hu.s,hg.s,greatest(lg.s,1e-9)) ELSE coalesce(hg.s,greatest(lg.s,1e-9)) END AS sc
  FROM b CROSS JOIN g CROSS JOIN lg JOIN u ON u.uid=b.uid JOIN ss ON ss.uid=b.uid AND ss.sid=b.sid LEFT JOIN hg ON hg.hour=b.hour
   LEFT JOIN hu ON hu.uid=b.uid AND hu.hour=b.hour LEFT JOIN hs ON hs.uid=b.uid AND hs.sid=b.sid AND hs.hour=b.hour)"""


@query("a5_robust_scores", f"""WITH {_A5} SELECT row_index, round(CASE WHEN x IS NOT NULL THEN greatest(-5,least(5,(x-zm)/greatest(zs,1e-12))) END,6)+0.0 AS delta_robust_z,
  round(CASE WHEN x IS NOT NULL THEN greatest(-5,least(5,(ln(greatest(x,0.5)+0.5)-sm)/greatest(sc,1e-9))) END,6)+0.0 AS delta_z_deseas_clipped FROM j""")
def _(spark, sf):
    rows = _by_gap_session(spark, sf).withColumn("delta_clipped_seconds", at_most(F.col("delta_seconds"), CLIP))
    z = X.robust_scores(rows, epsilon=0.5, min_samples=4)
    return z.select("row_index", *[r6(c).alias(c) for c in ("delta_robust_z", "delta_z_deseas_clipped")])


@query("a6_user_log_scores", f"""WITH {GAP}, x AS (SELECT row_index, uid, ln(coalesce(delta_seconds,0.0)+0.5) AS x FROM gap), s AS (SELECT uid, median(x) m, mad(x)*1.4826 sc FROM x GROUP BY uid)
  SELECT row_index, round(greatest(-5,least(5,(x-m)/CASE WHEN sc>0 THEN sc ELSE 1.4826*0.5 END)),6)+0.0 AS log_robust_z FROM x JOIN s USING (uid)""")
def _(spark, sf):
    return X.user_log_scores(gaps(spark, sf), epsilon=0.5).select("row_index", r6("log_robust_z").alias("log_robust_z"))


def _flags(spark, sf):
    return events(spark, sf).withColumn("flag", F.col("value") > 40).withColumn("s", F.col("value") / 40)


_W = "OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("l1_vote_and_hold", f"""WITH {EV}, v AS (SELECT *, sum(CASE WHEN value>40 THEN 1 ELSE 0 END) {_W.format(4)} >= 3 AS hit FROM ev)
  SELECT row_index, max(CASE WHEN hit THEN 1 ELSE 0 END) {_W.format(2)} = 1 AS alarm FROM v""")
def _(spark, sf):
    return L.vote_and_hold(_flags(spark, sf), ["uid"], ["epoch_s", "row_index"], "flag", 5, 3, 2).select("row_index", "alarm")


def _marks_sql(votes, set_on, release_on):
    return f"""WITH {EV}, v AS (SELECT *, CAST(sum(CASE WHEN value>40 THEN 1 ELSE 0 END) {_W.format(votes)} AS INTEGER) AS votes FROM ev),
  m AS (SELECT *, CASE WHEN {set_on} THEN 1 WHEN {release_on} THEN 0 END AS mark FROM v)
  SELECT row_index, votes, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS UNBOUNDED PRECEDING),0)=1 AS alarm FROM m"""


@query("l2_ratio_latch", _marks_sql(4, "votes>=3", "value/40 <= 1/1.1"))
def _(spark, sf):
    out = L.ratio_latch(_flags(spark, sf), ["uid"], ["epoch_s", "row_index"], "flag", "s", 3, 5, 1.1)
    return out.select("row_index", "votes", "alarm")


@query("l3_count_latch", _marks_sql(7, "votes>=5", "votes<=2"))
def _(spark, sf):
    out = L.count_latch(_flags(spark, sf), ["uid"], ["epoch_s", "row_index"], "flag", 4, 8, 0.6, 0.25)
    return out.select("row_index", "votes", "alarm")


# states 0-15: the last four votes as bits; 16: latched
@query("l4_clearing_latch", f"""WITH RECURSIVE {EV}, t AS (SELECT row_index, uid, row_number() OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS no, CAST(value/40>1 AS INTEGER) AS e, value/40<=1.0/1.1 AS rel FROM ev),
  w AS (SELECT uid, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS row_index, 0 AS state FROM t GROUP BY uid
    UNION ALL SELECT t.uid, t.no, t.row_index, CASE WHEN w.state=16 THEN CASE WHEN t.rel THEN 0 ELSE 16 END WHEN bit_count(w.state)+t.e>=3 THEN 16 ELSE (w.state*2+t.e)%16 END FROM w JOIN t ON t.uid=w.uid AND t.no=w.no+1)
  SELECT row_index, state=16 AS alarm FROM w WHERE no>0""")
def _(spark, sf):
    slim = _flags(spark, sf).select("uid", "epoch_s", "row_index", "s")
    return L.clearing_latch(slim, ["uid"], ["epoch_s", "row_index"], "s", 3, 5, 1.1).select("row_index", "alarm")


@query("w14_smoothed_scores", f"""WITH {EV}, t AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY uid) AS n, first_value(value) OVER w AS f FROM ev WINDOW w AS (PARTITION BY uid ORDER BY epoch_s, row_index))
  SELECT row_index, round(CASE WHEN n<5 THEN value ELSE (sum(value) {_W.format(4)} + greatest(5-rn,0)*f)/5 END,6)+0.0 AS smoothed FROM t""")
def _(spark, sf):
    out = A.smooth_scores(events(spark, sf), ["uid"], "value", 5)
    return out.select("row_index", r6("smoothed").alias("smoothed"))


_TRANS = f"""{EV}, tr AS (SELECT row_index, uid, epoch_s, CASE WHEN k%15<>0 THEN 's' || CAST(floor(epoch_s/86400) AS VARCHAR) END AS sid_final, CASE WHEN k%4=0 THEN 10000.0 WHEN k%4=1 THEN 50000.0 END AS threshold,
   CASE WHEN CAST(uid AS INTEGER)%3=0 THEN 20000.0 END AS user_threshold, CASE WHEN k%6=0 THEN 100.0 END AS dt_sec FROM ev),
  t2 AS (SELECT *, lag(sid_final) OVER w ps, lag(epoch_s) OVER w pt, lag(threshold) OVER w pth FROM tr WINDOW w AS (PARTITION BY uid ORDER BY epoch_s,row_index)),
  t3 AS (SELECT *, coalesce(threshold,pth,user_threshold) AS lim, coalesce(dt_sec, epoch_s-pt) AS gp FROM t2 WHERE ps<>sid_final)"""


@query("w16_transition_audit", f"""WITH {_TRANS} SELECT CASE WHEN lim IS NULL THEN 'missing_threshold' WHEN gp IS NULL THEN 'missing_delta' WHEN gp<=lim+1e-6 THEN 'below_threshold' ELSE 'ok' END AS finding, count(*) AS n FROM t3 GROUP BY 1""")
def _(spark, sf):
    e, k = events(spark, sf), F.col("k")
    rows = e.select(
        "row_index", "uid", "epoch_s",
        F.when(k % 15 != 0, F.concat(F.lit("s"), F.floor(F.col("epoch_s") / 86400).cast("double").cast("string"))).alias("sid_final"),
        F.when(k % 4 == 0, 10000.0).when(k % 4 == 1, 50000.0).alias("threshold"),
        F.when(F.col("uid").cast("int") % 3 == 0, 20000.0).alias("user_threshold"),
        F.when(k % 6 == 0, 100.0).alias("dt_sec"),
    )
    return S.transition_findings(rows).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


_ROT = f"""{EV}, r AS (SELECT row_index, epoch_s, CAST(floor(epoch_s/86400) AS BIGINT) AS day FROM ev),
  f AS (SELECT DISTINCT day FROM r), b AS (SELECT day AS prev_day, lead(day) OVER (ORDER BY day) AS next_day FROM f),
  c AS (SELECT prev_day, next_day, CAST(next_day AS DOUBLE)*CAST(86400.0 AS DOUBLE) AS t FROM b WHERE next_day IS NOT NULL),
  p AS (SELECT c.prev_day, c.t, count(*) FILTER (r.day=c.prev_day AND r.epoch_s>=t-300 AND r.epoch_s<=t) AS pn, max(r.epoch_s) FILTER (r.day=c.prev_day AND r.epoch_s>=t-300 AND r.epoch_s<=t) AS pmax,
     count(*) FILTER (r.day=c.next_day AND r.epoch_s>=t AND r.epoch_s<=t+300) AS nn, min(r.epoch_s) FILTER (r.day=c.next_day AND r.epoch_s>=t AND r.epoch_s<=t+300) AS nmin FROM c JOIN r ON r.day IN (c.prev_day,c.next_day) GROUP BY c.prev_day, c.t)"""


@query("w17_rotation_audit", f"""WITH {_ROT} SELECT t AS boundary_s, pn AS previous_count, nn AS next_count, round(nmin-pmax,6)+0.0 AS gap_s,
   array_to_string(list_filter([CASE WHEN pn=0 THEN 'missing_previous_window' END, CASE WHEN nn=0 THEN 'missing_next_window' END, CASE WHEN nmin-pmax>300 THEN 'gap_exceeds_window' END], lambda x: x IS NOT NULL),',') AS issues FROM p""")
def _(spark, sf):
    out = A.rotation_audit(events(spark, sf).select("epoch_s"), window_s=300.0)
    return out.select("boundary_s", "previous_count", "next_count", r6("gap_s").alias("gap_s"), F.array_join("issues", ",").alias("issues"))


_PROT = f"""{EV}, q0 AS (SELECT row_index, epoch_s, CASE event WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' WHEN 'purchase' THEN 'edit' WHEN 'click' THEN 'save' ELSE 'browse' END AS event,
   CASE event WHEN 'signup' THEN 'AUTH' WHEN 'error' THEN 'AUTH' WHEN 'view' THEN 'READ' ELSE 'UPDATE' END AS cat, CASE WHEN k%97=0 THEN NULL WHEN uid='7' THEN 's7' ELSE 'session-' || uid END AS sid,
   'user' || CAST(k%50=0 AS INTEGER) AS user_id, CASE WHEN k%9<>0 THEN 'tok' || CAST(k%60=0 AS INTEGER) END AS tok FROM ev),
 q1 AS (SELECT *, coalesce(sid,'') AS key FROM q0),
 q2 AS (SELECT *, row_number() OVER w AS rn, last_value(CASE event WHEN 'login' THEN 'in' WHEN 'logout' THEN 'out' END IGNORE NULLS) OVER p AS st, max(CASE WHEN event='login' THEN 1 ELSE 0 END) OVER p AS seen,
   first_value(user_id IGNORE NULLS) OVER p AS fu, first_value(tok IGNORE NULLS) OVER p AS ft, lag(event) OVER w AS le FROM q1
   WINDOW w AS (PARTITION BY key ORDER BY epoch_s,row_index), p AS (PARTITION BY key ORDER BY epoch_s,row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 q3 AS (SELECT *, CASE event WHEN 'login' THEN TRUE WHEN 'logout' THEN FALSE ELSE coalesce(st='in',FALSE) END AS authed, event='login' OR coalesce(seen,0)=1 AS sa FROM q2),
 q4 AS (SELECT row_index, unnest([CASE WHEN sid IS NULL THEN 'missingSessionId' WHEN NOT regexp_full_match(sid,'[A-Za-z0-9:_-]{{8,}}') THEN 'invalidSessionIdFormat' END,
   CASE WHEN rn=1 AND event<>'login' THEN 'missingInitialLogin' END, CASE WHEN st='out' THEN 'postLogoutOperation' END, CASE WHEN event='login' AND st='in' THEN 'duplicateLogin' END,
   CASE WHEN event='logout' AND coalesce(st,'')<>'in' THEN 'logoutWithoutLogin' END, CASE WHEN cat IN ('READ','UPDATE') AND NOT authed THEN CASE WHEN sa THEN 'unauthenticatedOperation' ELSE 'unauthenticatedBeforeLogin' END END,
   CASE WHEN fu<>user_id THEN 'userIdMismatch' END, CASE WHEN ft<>tok THEN 'tokenMismatch' END,
   CASE WHEN event<>'login' AND le IS NOT NULL AND (le||'->'||event) NOT IN ('login->browse','login->logout','browse->browse','browse->edit','browse->logout','edit->save','edit->browse','edit->logout','save->logout') THEN 'disallowedTransition' END]) AS reason FROM q3)"""


@query("w18_protocol_rules", f"WITH {_PROT} SELECT row_index, reason FROM q4 WHERE reason IS NOT NULL")
def _(spark, sf):
    e, k, ev = events(spark, sf), F.col("k"), F.col("event")
    rows = e.select(
        "row_index", "epoch_s",
        F.when(ev == "signup", "login").when(ev == "error", "logout").when(ev == "purchase", "edit")
        .when(ev == "click", "save").otherwise("browse").alias("event"),
        F.when(ev.isin("signup", "error"), "AUTH").when(ev == "view", "READ").otherwise("UPDATE").alias("op_category"),
        F.when(k % 97 == 0, None).when(F.col("uid") == "7", "s7").otherwise(F.concat(F.lit("session-"), "uid")).alias("session_id"),
        F.concat(F.lit("user"), (k % 50 == 0).cast("int").cast("string")).alias("user_id"),
        F.when(k % 9 != 0, F.concat(F.lit("tok"), (k % 60 == 0).cast("int").cast("string"))).alias("token"),
    )
    return P.protocol_violations(rows, token="token").select("row_index", F.explode("violations").alias("reason"))


def _streaks(key, frames):
    """Rows of a user, and the longest run of one event kind with the gap sum inside it; state crosses the frames."""
    n = run = best = 0
    last = kind = None
    for frame in frames:
        for event in frame["event"]:
            n, run, last = n + 1, run + 1 if event == last else 1, event
            if run > best:
                best, kind = run, event
    yield pd.DataFrame({"uid": [key[0]], "n": [n], "longest": [best], "event": [kind]})


@query("x6_each_user", f"""WITH {EV}, r AS (SELECT uid, event, row_number() OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS i,
   row_number() OVER (PARTITION BY uid, event ORDER BY epoch_s, row_index) AS j FROM ev),
 runs AS (SELECT uid, event, count(*) AS len, min(i) AS first FROM r GROUP BY uid, event, i - j),
 best AS (SELECT uid, max(len) AS longest, arg_max(event, (len, -first)) AS event FROM runs GROUP BY uid)
 SELECT uid, n, longest, event FROM best JOIN (SELECT uid, count(*) AS n FROM ev GROUP BY uid) USING (uid)""")
def _(spark, sf):
    rows = events(spark, sf).select("uid", "epoch_s", "row_index", "event")
    return for_each_group(rows, ["uid"], ["epoch_s", "row_index"], _streaks, "uid string, n long, longest long, event string")
