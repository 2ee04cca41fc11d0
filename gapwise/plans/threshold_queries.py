"""Queries over statistics and threshold estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import mixtures as M
from ..operators import statistics as T
from ..operators import tailfit as G
from ..operators import thresholds as H
from ..scale import durable, median_mad, quantiles
from .registry import query
from .views import EV, GAP, SCO, SES, events, gaps, r6, scored, sessions, table



def _cols(*names):
    return [r6(n).alias(n) for n in names]


def _sql(*names):
    return ", ".join(f"round({n},6)+0.0 AS {n}" for n in names)


@query("a1_measurement_floor", f"WITH {GAP} SELECT uid, greatest(1e-6, least(1e-2, 0.5*min(delta_seconds) FILTER (delta_seconds>0)))+0.0 AS epsilon FROM gap GROUP BY uid")
def _(spark, sf):
    return T.measurement_floor(gaps(spark, sf), ["uid"])


@query("a2_quantile_floor", f"WITH {GAP} SELECT greatest(1e-6, least(1e-2, 0.5*quantile_cont(delta_seconds,0.05)))+0.0 AS epsilon FROM gap WHERE delta_seconds>0")
def _(spark, sf):
    return T.quantile_floor(gaps(spark, sf))


@query("a3_median_mad", f"WITH {EV} SELECT op_category, count(value) AS n, {_sql('x_med','x_mad')} FROM (SELECT op_category, value, median(value) OVER (PARTITION BY op_category) AS x_med FROM ev) JOIN (SELECT op_category AS oc, mad(value) AS x_mad FROM ev GROUP BY 1) ON oc=op_category GROUP BY op_category, x_med, x_mad")
def _(spark, sf):
    m = median_mad(events(spark, sf), ["op_category"], "value")
    return m.select("op_category", "n", *_cols("x_med", "x_mad"))


_MOM = "count(d) AS n, round(avg(d),6) AS mean, round(stddev_pop(d),6) AS std_pop, round(stddev_samp(d),6) AS std_samp, round(min(d),6) AS lowest, round(max(d),6) AS highest"


@query("a8_moments", f"WITH {GAP} SELECT uid, {_MOM.replace('(d)','(delta_seconds)')} FROM gap GROUP BY uid")
def _(spark, sf):
    m = T.moments(gaps(spark, sf), ["uid"], "delta_seconds")
    return m.select("uid", "n", *_cols("mean", "std_pop", "std_samp", "lowest", "highest"))


@query("a8_merged_moments", f"WITH {GAP} SELECT op_category, count(delta_seconds) AS n, round(avg(delta_seconds),4) AS mean, round(stddev_pop(delta_seconds),3) AS std_pop FROM gap GROUP BY op_category")
def _(spark, sf):
    parts = T.moments(gaps(spark, sf).where("delta_seconds IS NOT NULL"), ["op_category", "uid"], "delta_seconds")
    m = T.merge_moments(parts, ["op_category"])
    return m.select("op_category", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 3).alias("std_pop"))


def _simple_sql(src, keys, p, x="x"):
    """Value at p by the ceil/midpoint rule from rows ranked as rn of n."""
    on = f"(n*{p})"
    return f"""(max(CASE WHEN rn = CASE WHEN {on}<>floor({on}) THEN ceil({on}) WHEN n%2=1 THEN {on}+1 ELSE {on} END THEN {x} END)
      + max(CASE WHEN rn = CASE WHEN {on}<>floor({on}) THEN ceil({on}) ELSE {on}+1 END THEN {x} END))/2"""


_LV = [0.1, 0.25, 0.5, 0.75, 0.9]
_A9 = f"""{GAP}, rk AS (SELECT op_category AS g, delta_seconds AS x, row_number() OVER (PARTITION BY op_category ORDER BY delta_seconds) AS rn, count(*) OVER (PARTITION BY op_category) AS n FROM gap WHERE delta_seconds IS NOT NULL)"""


def _d(p):
    return f"CAST({p} AS DOUBLE)"


@query("a9_quantile_table", f"WITH {_A9} " + " UNION ALL ".join(
    f"SELECT g AS op_category, max(n) AS n, {_d(p)} AS p, round({_simple_sql('rk','g',_d(p))},6)+0.0 AS value FROM rk GROUP BY g" for p in _LV))
def _(spark, sf):
    t = T.quantile_table(gaps(spark, sf).where("delta_seconds IS NOT NULL"), ["op_category"], "delta_seconds", _LV)
    return t.select("op_category", "n", "p", r6("value").alias("value"))


def _tier(level, key):
    part = f"PARTITION BY {key}" if key else ""
    cols = {"group": "uid, op_category", "user": "uid, '__all__' AS op_category", "global": "'__global__' AS uid, '__global__' AS op_category"}[level]
    return f"(SELECT '{level}' AS tier, {cols}, delta_seconds AS x, row_number() OVER ({part} ORDER BY delta_seconds) AS rn, count(*) OVER ({part}) AS n FROM gap WHERE delta_seconds IS NOT NULL)"


def _tier_quant(name, level, key):
    return f"{name} AS (SELECT tier, uid, op_category, max(n) AS n, {_simple_sql('', '', _d(0.99))} AS tau_hi, {_simple_sql('', '', _d(0.01))} AS tau_lo, {_simple_sql('', '', _d(0.5))} AS q50 FROM {_tier(level, key)} GROUP BY tier, uid, op_category)"


_TIERS = f"""{GAP}, {_tier_quant('tg','group','uid, op_category')}, {_tier_quant('tu','user','uid')}, {_tier_quant('tw','global','')},
 res AS (SELECT tg.uid, tg.op_category, CASE WHEN tg.n>=14 THEN 'group' WHEN tu.n>=60 OR tu.n>=14 THEN 'user' ELSE 'global' END AS tier,
   CASE WHEN tg.n>=14 THEN tg.n WHEN tu.n>=14 THEN tu.n ELSE tw.n END AS n, CASE WHEN tg.n>=14 THEN tg.tau_hi WHEN tu.n>=14 THEN tu.tau_hi ELSE tw.tau_hi END AS tau_hi,
   CASE WHEN tg.n>=14 THEN tg.tau_lo WHEN tu.n>=14 THEN tu.tau_lo ELSE tw.tau_lo END AS tau_lo, CASE WHEN tg.n>=14 THEN tg.q50 WHEN tu.n>=14 THEN tu.q50 ELSE tw.q50 END AS q50
   FROM tg JOIN tu ON tu.uid=tg.uid CROSS JOIN tw
  UNION ALL SELECT uid, op_category, tier, n, tau_hi, tau_lo, q50 FROM tu UNION ALL SELECT uid, op_category, tier, n, tau_hi, tau_lo, q50 FROM tw)"""


def quantile_stats(spark, sf, rows=None):
    rows = gaps(spark, sf).where("delta_seconds IS NOT NULL") if rows is None else rows
    return T.quantile_tiers(rows, "delta_seconds", min_samples=14)


@query("a10_quantile_tiers", f"WITH {_TIERS} SELECT uid, op_category, tier, n, {_sql('tau_hi','tau_lo','q50')} FROM res")
def _(spark, sf):
    t = quantile_stats(spark, sf)
    q50 = F.element_at(F.filter("cdf", lambda c: c["p"] == 0.5), 1)["value"]
    return t.withColumn("q50", q50).select("uid", "op_category", "tier", "n", *_cols("tau_hi", "tau_lo", "q50"))


@query("a11_alarm_budget", f"WITH {_TIERS} SELECT uid, op_category, CAST(n AS DOUBLE) AS weight, round(n/sum(n) OVER ()*0.01,9) AS q_alloc FROM res")
def _(spark, sf):
    b = T.alarm_budget(quantile_stats(spark, sf), 0.01)
    return b.select("uid", "op_category", "weight", F.round("q_alloc", 9).alias("q_alloc"))


@query("j4_tier_lookup", f"""WITH {_TIERS}, rows_ AS (SELECT row_index, CASE WHEN row_index%10=0 THEN 'new-' || uid ELSE uid END AS uid, CASE WHEN row_index%4=1 THEN 'OTHER' ELSE op_category END AS op_category FROM ev)
  SELECT r.row_index, round(coalesce(a.tau_hi,b.tau_hi,c.tau_hi),6)+0.0 AS tau_hi, CASE WHEN a.uid IS NOT NULL THEN 'group' WHEN b.uid IS NOT NULL THEN 'user' ELSE 'global' END AS lookup_level
  FROM rows_ r LEFT JOIN res a ON a.uid=r.uid AND a.op_category=r.op_category LEFT JOIN res b ON b.uid=r.uid AND b.op_category='__all__' LEFT JOIN res c ON c.uid='__global__'""")
def _(spark, sf):
    e, i = events(spark, sf), F.col("row_index")
    rows = e.select(
        "row_index",
        F.when(i % 10 == 0, F.concat(F.lit("new-"), "uid")).otherwise(F.col("uid")).alias("uid"),
        F.when(i % 4 == 1, "OTHER").otherwise(F.col("op_category")).alias("op_category"),
    )
    out = T.lookup(rows, durable(quantile_stats(spark, sf)), ["tau_hi"])
    return out.select("row_index", r6("tau_hi").alias("tau_hi"), "lookup_level")


def _profile_sql(col, src):
    return f"""SELECT '{col}' AS column_name, count(try_cast({col} AS DOUBLE)) AS n, round(avg({col}),6) AS mean, round(stddev_pop({col}),6) AS std, round(min({col}),6) AS lowest, round(max({col}),6) AS highest,
  count(*) FILTER ({col} IS NULL) AS missing, count(*) FILTER (lower(time_label)='unknown') AS unknown, round(quantile_cont({col},0.25),6) AS q25, round(quantile_cont({col},0.95),6) AS q95 FROM {src}"""


@query("a12_numeric_profile", f"WITH {GAP} {_profile_sql('delta_seconds','gap')} UNION ALL {_profile_sql('value','gap')}")
def _(spark, sf):
    p = A.numeric_profile(gaps(spark, sf), ["delta_seconds", "value"], {"delta_seconds": "time_label", "value": "time_label"})
    return p.select("column_name", "n", *_cols("mean", "std", "lowest", "highest"), "missing", "unknown", *_cols("q25", "q95"))


@query("a12_profile_change", f"""WITH {GAP}, a AS (SELECT 'value' AS c, quantile_cont(value,0.5) AS b5, quantile_cont(value,0.95) AS b9, quantile_cont(value*1000,0.5) AS a5, quantile_cont(value*1000,0.95) AS a9 FROM gap),
  b AS (SELECT 'delta_t' AS c, quantile_cont(delta_seconds,0.5) AS b5, quantile_cont(delta_seconds,0.95) AS b9, quantile_cont(delta_seconds,0.5) AS a5, quantile_cont(delta_seconds,0.95) AS a9 FROM gap)
  SELECT c AS column_name, round(a5-b5,6)+0.0 AS q50_diff, round(a9-b9,6)+0.0 AS q95_diff, CASE WHEN c='delta_t' THEN abs(a9-b9)/abs(b9)<=1e-6 END AS unit_kept FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _(spark, sf):
    g = gaps(spark, sf).withColumnRenamed("delta_seconds", "delta_t")
    cols = ["value", "delta_t"]
    before = A.numeric_profile(g, cols)
    after = A.numeric_profile(g.withColumn("value", F.col("value") * 1000), cols)
    return A.profile_change(before, after).select("column_name", *_cols("q50_diff", "q95_diff"), "unit_kept")


@query("a13_completeness", f"""WITH {EV}, r AS (SELECT CASE WHEN k%17=0 THEN 'NaN' WHEN k%13=0 THEN NULL ELSE uid END AS uid, CASE WHEN k%19=0 THEN ' none ' ELSE path END AS path, method FROM ev),
  c AS (SELECT 'uid' AS column_name, count(*) FILTER (uid IS NULL OR lower(trim(uid)) IN ('','null','none','na','nan')) AS missing, count(*) AS rows FROM r
   UNION ALL SELECT 'path', count(*) FILTER (lower(trim(path)) IN ('','null','none','na','nan')), count(*) FROM r UNION ALL SELECT 'method', 0, count(*) FROM r)
  SELECT column_name, missing, rows, round(1-missing/rows,6) AS completeness, missing=0 AS complete FROM c""")
def _(spark, sf):
    e, k = events(spark, sf), F.col("k")
    rows = e.select(
        F.when(k % 17 == 0, "NaN").when(k % 13 != 0, F.col("uid")).alias("uid"),
        F.when(k % 19 == 0, " none ").otherwise(F.col("path")).alias("path"),
        "method",
    )
    out = A.completeness(rows, ["uid", "path", "method"])
    return out.select("column_name", "missing", "rows", F.round("completeness", 6).alias("completeness"), "complete")


@query("a14_gap_statistics", f"""WITH {GAP} SELECT op_category, count(delta_seconds) AS n, round(avg(delta_seconds),6) AS mean, round(stddev_samp(delta_seconds),6) AS std, round(min(delta_seconds),6) AS lowest,
  round(max(delta_seconds),6) AS highest, round(quantile_cont(delta_seconds,0.95),6) AS p95 FROM gap GROUP BY op_category""")
def _(spark, sf):
    s = A.gap_statistics(gaps(spark, sf), ["op_category"])
    return s.select("op_category", "n", *_cols("mean", "std", "lowest", "highest", "p95"))


@query("a15_counts", f"WITH {SES} SELECT 'event' AS what, event AS value, count(*) AS n FROM ses GROUP BY event UNION ALL SELECT 'session', sid, count(*) FROM ses GROUP BY sid")
def _(spark, sf):
    s = sessions(spark, sf)
    a = A.counts_by(s, "event").withColumn("what", F.lit("event"))
    return a.unionByName(A.counts_by(s, "sid").withColumn("what", F.lit("session")))


@query("a16_session_table", f"""WITH {SES} SELECT sid AS session_id, any_value(uid) AS "group", min(epoch_s) AS start_s, max(epoch_s) AS end_s, count(*) AS events, CAST(sum(label) AS BIGINT) AS positive_events,
  CAST(count(*)-sum(label) AS BIGINT) AS negative_events, round(max(epoch_s)-min(epoch_s),6)+0.0 AS duration, CAST(sum(label)>0 AS INTEGER) AS has_positive FROM ses GROUP BY sid""")
def _(spark, sf):
    from ..operators.sessions import session_table

    t = session_table(sessions(spark, sf), session="sid")
    return t.withColumn("duration", r6("duration"))


@query("a17_vocabulary", f"""WITH {EV}, c AS (SELECT path AS token, count(*) AS freq FROM ev GROUP BY path)
  SELECT * FROM (VALUES ('<pad>',0,0),('<unk>',1,0),('<bos>',2,0)) t(token,id,freq) UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token)+2 AS INTEGER), freq FROM c WHERE freq>=2""")
def _(spark, sf):
    return T.vocabulary(events(spark, sf), "path", min_freq=2)


_CTX = f"""{EV}, tr0 AS (SELECT uid, event, lag(event) OVER w AS p1, lag(event,2) OVER w AS p2 FROM ev WINDOW w AS (PARTITION BY uid ORDER BY epoch_s, row_index)),
  tr AS (SELECT p2 || ' ' || p1 AS context, event AS target, count(*) AS n FROM tr0 WHERE p2 IS NOT NULL GROUP BY 1,2)"""


@query("a18_transitions", f"WITH {_CTX} SELECT context, target, n, CAST(sum(n) OVER (PARTITION BY context) AS BIGINT) AS context_n, round(n/sum(n) OVER (PARTITION BY context),6) AS p FROM tr")
def _(spark, sf):
    t = T.transitions(events(spark, sf), ["uid"], ["epoch_s", "row_index"], "event", context=2)
    return t.withColumn("p", r6("p"))


@query("a18_role_transitions", """WITH r AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), c AS (SELECT p AS context, role AS target, count(*) AS n FROM r WHERE p IS NOT NULL GROUP BY 1,2)
  SELECT context, target, n, CAST(sum(n) OVER (PARTITION BY context) AS BIGINT) AS context_n, round(n/sum(n) OVER (PARTITION BY context),6) AS p FROM c""")
def _(spark, sf):
    t = T.transitions(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role")
    return t.withColumn("p", r6("p"))


@query("a19_rate_table", f"""WITH {GAP}, v AS (SELECT count(DISTINCT path)+3 AS v, count(*) AS c FROM ev) SELECT uid, count(delta_seconds) AS n, round(ln(1/avg(delta_seconds)),6) AS g, round(-1/stddev_samp(delta_seconds),9) AS decay, round(stddev_samp(delta_seconds),6) AS scale,
  (SELECT CAST(least(256,greatest(32,pow(2,ceil(log2(v))))) AS INTEGER) FROM v) AS embedding_dim, (SELECT CASE WHEN c>=100000 THEN CAST(0.3 AS DOUBLE) WHEN c>=50000 THEN 0.25 WHEN c>=10000 THEN 0.2 ELSE 0.1 END FROM v) AS dropout FROM gap GROUP BY uid""")
def _(spark, sf):
    g = gaps(spark, sf)
    rates = T.rate_table(g, ["uid"])
    size = g.agg((F.count_distinct("path") + 3).alias("v"), F.count(F.lit(1)).alias("c"))
    s = T.model_sizes(F.col("v"), F.col("c"))
    one = size.select(s["embedding_dim"].alias("embedding_dim"), s["dropout"].alias("dropout"))
    from ..scale import attach

    out = attach(rates, one, [])
    return out.select("uid", "n", r6("g").alias("g"), F.round("decay", 9).alias("decay"), r6("scale").alias("scale"), "embedding_dim", "dropout")


@query("a20_score_histogram", f"""WITH {EV}, e AS (SELECT min(value) lo, max(value) hi, count(*) n FROM ev), b AS (SELECT CAST(least(floor((value-lo)/((hi-lo)/20)),19) AS INTEGER) AS bin, count(*) AS n FROM ev, e GROUP BY 1),
  g AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) SELECT g.bin, round(lo+(hi-lo)/20*g.bin,6) AS left_edge, round(lo+(hi-lo)/20*(g.bin+1),6) AS right_edge, coalesce(b.n,0) AS n, round(coalesce(b.n,0)/e.n/((hi-lo)/20),9) AS density FROM g CROSS JOIN e LEFT JOIN b ON b.bin=g.bin""")
def _(spark, sf):
    h = A.histogram(events(spark, sf), "value", 20)
    return h.select("bin", *_cols("left_edge", "right_edge"), "n", F.round("density", 9).alias("density"))


@query("a20_score_summary", f"WITH {EV} SELECT count(value) AS n, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std, min(value) AS lowest, max(value) AS highest, round(quantile_cont(value,0.05),6) AS p05, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95 FROM ev")
def _(spark, sf):
    s = A.score_summary(events(spark, sf), "value")
    return s.select("n", *_cols("mean", "std"), "lowest", "highest", *_cols("p05", "p50", "p95"))


@query("a21_threshold_conflicts", f"WITH {EV}, t AS (SELECT uid, CASE WHEN CAST(uid AS INTEGER)%10=3 AND k%2=0 THEN 900.0 WHEN k%5=0 THEN 1800.0 END AS threshold FROM ev) SELECT uid, CAST(min(threshold) AS DOUBLE) AS lowest, CAST(max(threshold) AS DOUBLE) AS highest, coalesce(max(threshold)-min(threshold)>1e-6,FALSE) AS conflict FROM t GROUP BY uid")
def _(spark, sf):
    e, k = events(spark, sf), F.col("k")
    rows = e.select(
        "uid",
        F.when((F.col("uid").cast("int") % 10 == 3) & (k % 2 == 0), "900").alias("DeltaT"),
        F.when(k % 5 == 0, "1800").when(k % 7 == 0, "none").alias("idle_timeout_seconds"),
    ).withColumn("threshold", A.first_threshold(["DeltaT", "idle_timeout_seconds"]))
    return A.threshold_conflicts(rows)


@query("a21_audit_summary", f"WITH {GAP} SELECT CAST(5 AS BIGINT) AS files, count(*) AS rows, count(DISTINCT uid) AS users, round(count(*) FILTER (time_label='unknown')/count(*),6) AS unknown_ratio, (SELECT count(*) FROM ev WHERE k%29=0) AS findings FROM gap")
def _(spark, sf):
    g = gaps(spark, sf).withColumn("source", F.concat(F.lit("f"), (F.col("row_index") % 5).cast("string")))
    bad = g.where(F.col("k") % 29 == 0)
    return A.audit_summary(g, bad, "source")


_TD = f"""{EV}, s0 AS (SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY epoch_s,row_index) AS DOUBLE) AS t, value AS y FROM ev), s AS (SELECT uid, t, CASE WHEN t<=20 THEN 0.0 ELSE 30.0 END AS r, y FROM s0),
  w AS (SELECT *, lag(t) OVER v t0, lag(r) OVER v r0, lag(y) OVER v y0 FROM s WINDOW v AS (PARTITION BY uid ORDER BY t)),
  b AS (SELECT uid, sum((t-t0)*(abs(r-y)+abs(r0-y0))/2) iae, sum((t-t0)*((r-y)*(r-y)+(r0-y0)*(r0-y0))/2) ise, sum((t-t0)*(abs(r-y)*t+abs(r0-y0)*t0)/2) itae, count(*) FILTER (abs(r-r0)>0.3) steps, arg_max(r,t) rf, arg_max(y,t) yl, max(t) tn, max(t) FILTER (abs(r-r0)>0.3) ati FROM w GROUP BY uid),
  g AS (SELECT w.*, b.tn, b.ati FROM w JOIN b USING (uid) WHERE b.ati IS NOT NULL AND t>=ati-1),
  c AS (SELECT uid, arg_min(CASE WHEN t=ati-1 OR y=y0 THEN t ELSE t0+(3.0-y0)*(t-t0)/(y-y0) END, t) FILTER (y>=3.0) t10, arg_min(CASE WHEN t=ati-1 OR y=y0 THEN t ELSE t0+(27.0-y0)*(t-t0)/(y-y0) END, t) FILTER (y>=27.0) t90,
    max(t) FILTER (abs(y-30.0)>0.6) lastv, max((y-30.0)/30.0) ov, min(ati)-1 st FROM g GROUP BY uid)"""


@query("a22_response_metrics", f"""WITH {_TD} SELECT b.uid, round(iae,6) AS iae, round(ise,6) AS ise, round(itae,6) AS itae, steps=1 AS is_step, round(t90-t10,6)+0.0 AS rise_time,
  round(CASE WHEN ati IS NULL THEN NULL WHEN lastv IS NULL THEN st WHEN lastv=tn THEN tn ELSE lastv+1 END,6)+0.0 AS settling_time, round(ov*100,6) AS overshoot_pct, round(rf-yl,6)+0.0 AS steady_state_error FROM b LEFT JOIN c USING (uid)""")
def _(spark, sf):
    from ..scale import running_sum, scan

    s = scan(events(spark, sf), ["uid"], ["epoch_s", "row_index"], {"t": running_sum(F.lit(1))})
    s = s.select("uid", F.col("t").cast("double").alias("t"), F.col("value").alias("y"))
    s = s.withColumn("r", F.when(F.col("t") <= 20, 0.0).otherwise(30.0))
    m = A.response_metrics(s, ["uid"])
    return m.select("uid", *_cols("iae", "ise", "itae"), "is_step",
                    *_cols("rise_time", "settling_time", "overshoot_pct", "steady_state_error"))


# histograms and knees ---------------------------------------------------------

_POS = GAP + ", pos AS (SELECT uid AS g, delta_seconds AS x, ln(delta_seconds) AS l FROM gap WHERE delta_seconds>0)"
_LAY = (
    _POS
    + """, lay0 AS (SELECT g, count(*) AS n, ln(CASE WHEN floor(min(x)*1e9)/1e9>0 THEN floor(min(x)*1e9)/1e9 ELSE min(x) END) AS lo, ln(ceil(max(x)*1e9)/1e9) AS hi, quantile_cont(l,0.25) AS q1, quantile_cont(l,0.75) AS q3 FROM pos GROUP BY g),
 lay AS (SELECT *, CAST(CASE WHEN hi<=lo THEN 1 ELSE least(512,greatest(32,ceil((hi-lo)/CASE WHEN q3>q1 THEN 2*(q3-q1)/cbrt(n) ELSE (hi-lo)/512 END))) END AS INTEGER) AS bins FROM lay0),
 lh AS (SELECT pos.g, CAST(CASE WHEN hi<=lo THEN 0 ELSE greatest(0,least(bins-1,floor((l-lo)/((hi-lo)/bins)))) END AS INTEGER) AS bin, count(*) AS n, any_value(lo) AS lo, any_value((hi-lo)/bins) AS w, any_value(bins) AS bins, any_value(hi) AS hi FROM pos JOIN lay USING (g) GROUP BY 1,2)"""
)


def _cut(src, out):
    """Best cut of histogram ``src`` (g, bin, n, c)."""
    return f"""{out}0 AS (SELECT g, bin, sum(n) OVER w AS cn, sum(n*c) OVER w AS cs, sum(n) OVER (PARTITION BY g) AS tn, sum(n*c) OVER (PARTITION BY g) AS ts, sum(n*c*c) OVER (PARTITION BY g) AS tq FROM {src} WINDOW w AS (PARTITION BY g ORDER BY bin)),
 {out}1 AS (SELECT *, CASE WHEN tn>cn THEN cn/tn*((tn-cn)/tn)*(cs/cn-(ts-cs)/(tn-cn))*(cs/cn-(ts-cs)/(tn-cn)) END AS b, greatest(tq/tn-(ts/tn)*(ts/tn),0) AS v FROM {out}0),
 {out} AS (SELECT g, max(v) AS v, max(b) AS b, (SELECT bin FROM {out}1 i WHERE i.g=o.g AND i.b IS NOT NULL ORDER BY round(i.b,12) DESC, bin LIMIT 1) AS cut FROM {out}1 o GROUP BY g)"""


@query("t1_log_histogram", f"""WITH {_LAY}, grid AS (SELECT g, lo, hi, bins, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM lay)
  SELECT grid.g AS uid, grid.bin, round(exp(grid.lo+(grid.hi-grid.lo)/grid.bins*grid.bin),4) AS lo, round(exp(grid.lo+(grid.hi-grid.lo)/grid.bins*grid.bin+(grid.hi-grid.lo)/grid.bins),4) AS hi, coalesce(lh.n,0) AS n FROM grid LEFT JOIN lh ON lh.g=grid.g AND lh.bin=grid.bin""")
def _(spark, sf):
    wv = durable(H.positive(gaps(spark, sf), ["uid"], "delta_seconds"))
    lay = H.log_layout(wv, ["uid"])
    full = H.full_histogram(H.log_histogram(wv, lay, ["uid"]), lay, ["uid"])
    return full.select("uid", "bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


_T2 = f"""{_LAY}, lhc AS (SELECT g, bin, n, lo+w*(bin+0.5) AS c FROM lh), {_cut('lhc','oc')},
 ot AS (SELECT lay.g, lay.bins AS fd_bins, CASE WHEN hi>lo AND b>0 THEN least(lo+(hi-lo)/bins*(cut+1),hi) ELSE lo END AS tau_log, CASE WHEN hi>lo AND b>0 AND v>0 THEN b/v ELSE 0 END AS quality FROM lay JOIN oc USING (g))"""


@query("t2_otsu_log", f"WITH {_T2} SELECT g AS uid, fd_bins, {_sql('tau_log','quality')} FROM ot")
def _(spark, sf):
    wv = durable(H.positive(gaps(spark, sf), ["uid"], "delta_seconds"))
    lay = H.log_layout(wv, ["uid"])
    o = H.otsu_log(H.log_histogram(wv, lay, ["uid"]), lay, ["uid"])
    return o.select("uid", "fd_bins", *_cols("tau_log", "quality"))


_T3 = f"""{_POS}, e AS (SELECT g, count(*) n, min(x) lo, max(x) hi, least(256,greatest(2,floor(sqrt(count(*))))) bins FROM pos GROUP BY g),
 h3 AS (SELECT pos.g, greatest(0,least(bins-1,floor((x-lo)/((hi-lo)/bins)))) AS bin, count(*) AS n, any_value(lo) lo, any_value((hi-lo)/bins) w FROM pos JOIN e USING (g) WHERE hi>lo GROUP BY 1,2), h3c AS (SELECT g,bin,n,lo+w*(bin+0.5) AS c FROM h3), {_cut('h3c','c3')}"""


@query("t3_otsu_linear", f"WITH {_T3} SELECT e.g AS uid, round(CASE WHEN hi=lo THEN hi ELSE lo+(hi-lo)/bins*(cut+0.5) END,6)+0.0 AS tau FROM e LEFT JOIN c3 USING (g)")
def _(spark, sf):
    return H.otsu_linear(H.positive(gaps(spark, sf), ["uid"], "delta_seconds"), ["uid"]).select("uid", *_cols("tau"))


def _t4(bins):
    return f"""{_POS}, e AS (SELECT g, count(*) n, min(l) lo, max(l) hi, {bins} AS bins FROM pos GROUP BY g),
 h4 AS (SELECT pos.g, greatest(0,least(bins-1,floor((l-lo)/((hi-lo)/bins)))) AS bin, count(*) AS n, any_value(lo) lo, any_value((hi-lo)/bins) w FROM pos JOIN e USING (g) WHERE hi>lo GROUP BY 1,2), h4c AS (SELECT g,bin,n,lo+w*(bin+0.5) AS c FROM h4), {_cut('h4c','c4')}"""


_T4D, _T4L = _t4("greatest(8,least(128,floor(sqrt(count(*))+0.5)))"), _t4("least(128,greatest(16,floor(sqrt(count(*)))))")


@query("t4_otsu_detector", f"WITH {_T4D} SELECT e.g AS uid, n AS n_rows, round(exp(lo+(hi-lo)/bins*(cut+0.5)),4) AS tau FROM e JOIN c4 USING (g)")
def _(spark, sf):
    o = H.otsu_log_even(H.positive(gaps(spark, sf), ["uid"], "delta_seconds"), ["uid"])
    return o.select("uid", "n_rows", F.round("tau", 4).alias("tau"))


_KNEE = """, kr AS (SELECT g, l, row_number() OVER (PARTITION BY g ORDER BY l) AS rn, count(*) OVER (PARTITION BY g) AS n, min(l) OVER (PARTITION BY g) AS lo, max(l) OVER (PARTITION BY g) AS hi FROM pos),
 kd AS (SELECT g, l, n, lo, hi, abs((l-lo)/(hi-lo)-(rn-1)/(n-1))/sqrt(2) AS d FROM kr), kn AS (SELECT g, any_value(n) AS n, max(hi) AS hi, max(lo) AS lo, max(d) AS d, (SELECT l FROM kd i WHERE i.g=o.g ORDER BY round(i.d,12) DESC, l LIMIT 1) AS knee FROM kd o GROUP BY g)"""


@query("t4_t7_loader_threshold", f"WITH {_T4L}{_KNEE} SELECT e.g AS uid, round(greatest(exp(kn.knee),exp(e.lo+(e.hi-e.lo)/bins*(cut+1))),4) AS tau FROM e JOIN c4 USING (g) JOIN kn ON kn.g=e.g")
def _(spark, sf):
    t = H.loader_threshold(H.positive(gaps(spark, sf), ["uid"], "delta_seconds"), ["uid"])
    return t.select("uid", F.round("tau", 4).alias("tau"))


@query("t7_sorted_knee", f"WITH {_T4D}{_KNEE} SELECT e.g AS uid, e.n AS n_rows, round(greatest(exp(kn.knee),exp(e.lo+(e.hi-e.lo)/bins*(cut+0.5))),4) AS tau FROM e JOIN c4 USING (g) JOIN kn ON kn.g=e.g")
def _(spark, sf):
    t = H.detector_knee(H.positive(gaps(spark, sf), ["uid"], "delta_seconds"), ["uid"])
    return t.select("uid", "n_rows", F.round("tau", 4).alias("tau"))


def _gated(src, sign="1.0"):
    """CTEs of the gated Otsu over ``src`` (g, x); result og (g, n, bins, peaks, tau, reason)."""
    return f"""gs AS (SELECT g, x*{sign} AS x FROM {src} WHERE x IS NOT NULL),
 ge0 AS (SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi, var_pop(x) AS vr, 2*(quantile_cont(x,0.75)-quantile_cont(x,0.25))/pow(count(*),1.0/3) AS fw FROM gs GROUP BY g),
 ge AS (SELECT *, CAST(CASE WHEN fw>0 THEN greatest(2,ceil((hi-lo)/fw)) ELSE 2 END AS INTEGER) AS bins FROM ge0),
 gh AS (SELECT gs.g, CAST(CASE WHEN hi>lo THEN greatest(0,least(bins-1,floor((x-lo)/((hi-lo)/bins)))) ELSE 0 END AS INTEGER) AS bin, count(*) AS n, any_value(lo) AS lo, any_value((hi-lo)/bins) AS w, any_value(bins) AS bins FROM gs JOIN ge USING (g) GROUP BY 1,2),
 gn AS (SELECT g, b AS bin, sum(n) AS s, any_value(bins) AS bins FROM (SELECT g, bins, n, unnest([bin-1,bin,bin+1]) AS b FROM gh) WHERE b>=0 AND b<bins GROUP BY g, b),
 gp AS (SELECT a.g, count(*) FILTER (a.bin>0 AND a.bin<a.bins-1 AND a.s>coalesce(p.s,0) AND a.s>=coalesce(q.s,0)) AS peaks FROM gn a LEFT JOIN gn p ON p.g=a.g AND p.bin=a.bin-1 LEFT JOIN gn q ON q.g=a.g AND q.bin=a.bin+1 GROUP BY a.g),
 ghc AS (SELECT g,bin,n,lo+w*(bin+0.5) AS c FROM gh), {_cut('ghc','gc')},
 og AS (SELECT ge.g, ge.n, ge.bins, gp.peaks, CASE WHEN ge.n<2 OR hi-lo<=1e-9*greatest(abs(hi),abs(lo)) THEN 'degenerate' WHEN bins>2 AND peaks<2 THEN 'unimodal' WHEN vr<=1e-12 THEN 'degenerate_variance'
   WHEN coalesce(cut,0)=0 OR cut=bins-1 THEN 'no_separation' WHEN b<=1e-12 THEN 'no_variance' WHEN b/(vr+1e-12)<0.2 THEN 'low_contrast' END AS reason, (lo+(hi-lo)/bins*(cut+0.5))*{sign} AS tau0 FROM ge JOIN gp USING (g) JOIN gc USING (g))"""


_LOGS = GAP + ", src AS (SELECT uid AS g, ln(delta_seconds) AS x FROM gap WHERE delta_seconds>0)"


def _log_gaps(spark, sf):
    return gaps(spark, sf).where("delta_seconds > 0").withColumn("x", F.ln("delta_seconds"))


@query("t5_gated_otsu", f"WITH {_LOGS}, {_gated('src')} SELECT g AS uid, n AS n_rows, bins, peaks, round(CASE WHEN reason IS NULL THEN tau0 END,6)+0.0 AS tau, reason FROM og")
def _(spark, sf):
    o = H.otsu_gated(_log_gaps(spark, sf), ["uid"], "x")
    return o.select("uid", "n_rows", "bins", "peaks", *_cols("tau"), "reason")


@query("t5_gated_otsu_lower", f"WITH {_LOGS}, {_gated('src', '-1.0')} SELECT g AS uid, round(CASE WHEN reason IS NULL THEN tau0 END,6)+0.0 AS tau, reason FROM og")
def _(spark, sf):
    return H.otsu_gated(_log_gaps(spark, sf), ["uid"], "x", side="lower").select("uid", *_cols("tau"), "reason")


_T6 = f"""{_T2}, sg AS (SELECT g, min(l) l0, max(l) l1, sqrt(greatest(var_pop(l),1e-6)) sd FROM pos GROUP BY g),
 kp0 AS (SELECT sg.g, greatest(l0,tau_log-2*sd) a0, least(l1,tau_log+2*sd) b0, l0, l1 FROM sg JOIN ot USING (g)), kp1 AS (SELECT g, CASE WHEN b0>a0 THEN a0 ELSE l0 END a, CASE WHEN b0>a0 THEN b0 ELSE l1 END b FROM kp0),
 kp AS (SELECT *, CASE WHEN floor((b-a)/0.05)+1<16 THEN (b-a)/15 ELSE 0.05 END AS h FROM kp1), kp2 AS (SELECT *, CAST(CASE WHEN b>a THEN floor((b-a+0.5*h)/h) ELSE 0 END AS INTEGER) AS last FROM kp),
 kg AS (SELECT g, a, b, h, last, CAST(unnest(range(last+1)) AS INTEGER) AS i FROM kp2), kg2 AS (SELECT g, i, last, CASE WHEN i=last THEN CASE WHEN b>a THEN b ELSE a END ELSE a+i*h END AS lt FROM kg),
 kc AS (SELECT kg2.g, i, any_value(lt) AS lt, count(*) FILTER (x>exp(lt)*(1+1e-12))+1 AS sessions FROM kg2 JOIN pos USING (g) GROUP BY kg2.g, i), ks AS (SELECT *, avg(sessions) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM kc),
 ke AS (SELECT *, min(lt) OVER q x0, max(lt) OVER q x1, min(sm) OVER q y0, max(sm) OVER q y1, count(*) OVER q m FROM ks WINDOW q AS (PARTITION BY g)),
 kd6 AS (SELECT *, CASE WHEN x1>x0 AND y1>y0 THEN abs((sm-y0)/(y1-y0)+(lt-x0)/(x1-x0)-1)/sqrt(2) END AS d FROM ke),
 kk AS (SELECT g, exp(CASE WHEN max(d) IS NULL THEN max(lt) FILTER (i=floor(m/2)) ELSE (SELECT lt FROM kd6 z WHERE z.g=o.g ORDER BY round(z.d,12) DESC, i LIMIT 1) END) AS knee FROM kd6 o GROUP BY g)"""


@query("t6_knee_curve", f"WITH {_T6} SELECT g AS uid, i, sessions, round(sm,6) AS smoothed, round(lt,6)+0.0 AS log_threshold FROM ks")
def _(spark, sf):
    wv = durable(H.positive(gaps(spark, sf), ["uid"], "delta_seconds"))
    lay = durable(H.log_layout(wv, ["uid"]))
    c = H.knee_curve(wv, H.otsu_log(H.log_histogram(wv, lay, ["uid"]), lay, ["uid"]), ["uid"])
    return c.select("uid", "i", "sessions", *_cols("smoothed", "log_threshold"))


@query("t6_knee_threshold", f"WITH {_T6} SELECT g AS uid, round(knee,4) AS knee FROM kk")
def _(spark, sf):
    wv = durable(H.positive(gaps(spark, sf), ["uid"], "delta_seconds"))
    lay = durable(H.log_layout(wv, ["uid"]))
    c = H.knee_curve(wv, H.otsu_log(H.log_histogram(wv, lay, ["uid"]), lay, ["uid"]), ["uid"])
    return H.knee_of_curve(c, ["uid"]).select("uid", F.round("knee", 4).alias("knee"))


_T8 = GAP + ", pos AS (SELECT uid AS g, value AS l FROM gap)" + _KNEE


@query("t8_knee_chord", f"WITH {_T8} SELECT g AS uid, n AS n_rows, round(CASE WHEN n>=3 AND d>1e-8 THEN knee END,6)+0.0 AS tau, CASE WHEN n<3 THEN 'too_few_samples' WHEN d<=1e-8 THEN 'flat_curve' END AS reason FROM kn")
def _(spark, sf):
    return H.knee_chord(events(spark, sf), ["uid"], "value").select("uid", "n_rows", *_cols("tau"), "reason")


@query("t9_bimodality")
def _(spark, sf):
    return M.bimodality(H.positive(gaps(spark, sf), ["op_category"], "delta_seconds"), ["op_category"])


_T10 = f"{_T6}, p95 AS (SELECT g, count(*) AS n, quantile_cont(x,0.95) AS p FROM pos GROUP BY g)"


@query("t10_single_mode_threshold", f"WITH {_T10} SELECT p95.g AS uid, n AS n_rows, CASE WHEN n<50 THEN 0 ELSE fd_bins END AS fd_bins, round(CASE WHEN n<50 THEN p ELSE greatest(knee,p) END,4) AS delta_t FROM p95 JOIN ot USING (g) JOIN kk USING (g)")
def _(spark, sf):
    t = H.combined_session_threshold(gaps(spark, sf), ["uid"], min_samples=50, bimodal=False)
    return t.select("uid", "n_rows", "fd_bins", F.round("delta_t", 4).alias("delta_t"))


@query("t10_session_threshold")
def _(spark, sf):
    return H.combined_session_threshold(gaps(spark, sf), ["uid"])


def _p95(df, keys, value):
    return quantiles(df.where(F.col(value) > 0), keys, value, {"delta_t": 0.95}, size="n_rows")


@query("t11_backoff", f"""WITH {GAP}, us AS (SELECT uid, arg_min(event,row_index) AS grp, count(delta_seconds) FILTER (delta_seconds>0) AS n, quantile_cont(delta_seconds,0.95) AS p FROM gap GROUP BY uid),
  gr AS (SELECT event AS grp, count(delta_seconds) AS n, quantile_cont(delta_seconds,0.95) AS p FROM gap GROUP BY event), gl AS (SELECT count(delta_seconds) AS n, quantile_cont(delta_seconds,0.95) AS p FROM gap)
  SELECT uid, CASE WHEN us.n>=60 THEN 'user' WHEN gr.n>=60 THEN 'group:event=' || us.grp ELSE 'global' END AS backoff_level, CASE WHEN us.n>=60 THEN us.n WHEN gr.n>=60 THEN gr.n ELSE gl.n END AS n_rows,
   round(CASE WHEN us.n>=60 THEN us.p WHEN gr.n>=60 THEN gr.p ELSE gl.p END,6) AS delta_t FROM us JOIN gr USING (grp) CROSS JOIN gl""")
def _(spark, sf):
    t = H.backoff_thresholds(gaps(spark, sf), group="event", min_events=60, estimator=_p95)
    return t.select("uid", "backoff_level", "n_rows", *_cols("delta_t"))


@query("t11_backoff_combined")
def _(spark, sf):
    return H.backoff_thresholds(gaps(spark, sf), group=F.col("event"), label="event", min_events=60)


@query("t12_hierarchical_pick", f"""WITH {GAP}, u AS (SELECT uid, op_category, count(delta_seconds) n, ln(median(delta_seconds)) o, ln(quantile_cont(delta_seconds,0.9)) k FROM gap GROUP BY uid, op_category), c AS (SELECT op_category, count(delta_seconds) n, ln(median(delta_seconds)) o, ln(quantile_cont(delta_seconds,0.9)) k FROM gap GROUP BY op_category)
  SELECT u.uid, u.op_category, round(exp(CASE WHEN u.n>=14 THEN CASE WHEN u.n%2=0 THEN u.k ELSE u.o END ELSE CASE WHEN c.n%2=0 THEN c.k ELSE c.o END END),4) AS delta_t FROM u JOIN c USING (op_category)""")
def _(spark, sf):
    from ..scale import attach, join_on

    g = gaps(spark, sf)

    def level(keys):
        q = quantiles(g, keys, "delta_seconds", {"m": 0.5, "k": 0.9}, size="n")
        return q.select(*keys, F.struct(F.col("n").alias("event_count"), F.ln("m").alias("tau_otsu"), F.ln("k").alias("tau_knee"), (F.col("n") % 2 == 0).alias("use_knee")).alias("_s"))

    out = level(["uid", "op_category"]).withColumnRenamed("_s", "user")
    out = join_on(out, level(["op_category"]).withColumnRenamed("_s", "group"), ["op_category"])
    out = attach(out, level([]).withColumnRenamed("_s", "global"), [])
    return out.select("uid", "op_category", F.round(H.pick_hierarchical(out, min_events=14), 4).alias("delta_t"))


@query("t13_quantile_threshold", f"WITH {GAP} SELECT uid, count(delta_seconds) AS n, round(quantile_cont(delta_seconds,0.995),6) AS tau_hi, round(quantile_cont(delta_seconds,0.005),6) AS tau_lo FROM gap GROUP BY uid")
def _(spark, sf):
    return H.quantile_threshold(gaps(spark, sf), ["uid"], "delta_seconds").select("uid", "n", *_cols("tau_hi", "tau_lo"))


def _t14(keys, src):
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""mu AS (SELECT *, quantile_cont(x,0.9) OVER ({part}) AS u, count(x) OVER ({part}) AS n FROM {src}), me AS (SELECT {keys}, any_value(u) u, any_value(n) n, count(*) FILTER (x>u) ne, avg(x-u) FILTER (x>u) m, var_pop(x-u) FILTER (x>u) v FROM mu GROUP BY {keys}),
 mf AS (SELECT *, CASE WHEN ne>=2 AND v>0 THEN greatest(-0.9,least(0.95,0.5*(1-m*m/v))) ELSE 0 END AS xi FROM me), mg AS (SELECT *, CASE WHEN ne=0 THEN 1e-6 WHEN ne>=2 AND v>0 THEN greatest(m*(1-xi),1e-9) WHEN ne=1 THEN greatest(m,1e-6) ELSE greatest(m,1e-9) END AS beta, ne/n AS p_ref FROM mf),
 mh AS (SELECT *, greatest(least(1-0.9, CASE WHEN p_ref>0 THEN p_ref ELSE 1-0.9 END),1e-6) AS q_star FROM mg), mt AS (SELECT *, CASE WHEN p_ref>0 THEN greatest(u, CASE WHEN abs(xi)<1e-6 THEN u+beta*ln(p_ref/q_star) ELSE u+beta/xi*(pow(p_ref/q_star,xi)-1) END) ELSE u END AS tau FROM mh)"""


@query("t14_tail_by_moments", f"WITH {GAP}, sx AS (SELECT uid, delta_seconds AS x FROM gap WHERE delta_seconds IS NOT NULL), {_t14('uid','sx')} SELECT uid, n, ne AS n_exc, {_sql('u','xi','p_ref','q_star')}, round(beta,4) AS beta, round(tau,4) AS tau FROM mt")
def _(spark, sf):
    t = H.tail_by_moments(gaps(spark, sf), ["uid"], "delta_seconds", 0.9)
    return t.select("uid", "n", "n_exc", *_cols("u", "xi", "p_ref", "q_star"), F.round("beta", 4).alias("beta"), F.round("tau", 4).alias("tau"))


def _tail_fit_sql(keys: str, src: str, bounds: tuple[float, float], xi_eps: float) -> str:
    """Tables up to ``tail`` (keys, xi, beta, estimator): the profile likelihood grid of T17 over ``src`` (keys, y, n)."""
    # 1 - exp and ln(1 + x) without loss for small arguments
    em1 = "CASE WHEN exp({w}) = 1 THEN {w} ELSE (exp({w}) - 1) * {w} / ln(exp({w})) END"
    l1p = "CASE WHEN 1 + ({x}) = 1 THEN ({x}) WHEN 1 + ({x}) <= 0 THEN -'infinity'::DOUBLE ELSE ln(1 + ({x})) * ({x}) / ((1 + ({x})) - 1) END"
    parts = [f"tb AS (SELECT {keys}, sum(n)::DOUBLE AS size, sum(n * y) / sum(n) AS mean, max(y) AS top, {G.FIRST[0]}::DOUBLE AS w FROM {src} GROUP BY {keys})"]
    grids = [(G.FIRST[1], 0, G.FIRST[2]), *[(step, G.POINTS // 2, G.POINTS) for step in G.STEPS]]
    xi = f"least(greatest(m, {bounds[0]}), {bounds[1]})"
    from_ = "tb"
    for i, (step, middle, points) in enumerate(grids):
        theta = f"({em1.format(w='g.pt')}) / g.top"
        parts.append(f"""g{i} AS (SELECT *, w + {step!r}::DOUBLE * (k - {middle}) AS pt FROM {from_}, (SELECT unnest(range({points})) AS k)),
 s{i} AS (SELECT {keys}, k, any_value(g.pt) AS pt, any_value(size) AS size, any_value(mean) AS mean, any_value(top) AS top, sum(x.n * ({l1p.format(x=f'{theta} * x.y')})) / any_value(size) AS m
   FROM {src} x JOIN g{i} g USING ({keys}) GROUP BY {keys}, k),
 c{i} AS (SELECT *, CASE WHEN abs(pt) < 1e-12 THEN ln(mean) + 1 ELSE ln(({xi}) * top / ({em1.format(w='pt')})) + (1 + 1 / ({xi})) * m END AS cost FROM s{i}),
 n{i} AS (SELECT *, lag(cost) OVER (PARTITION BY {keys} ORDER BY k) AS before, lead(cost) OVER (PARTITION BY {keys} ORDER BY k) AS after FROM c{i}),
 b{i} AS (SELECT {keys}, size, mean, top, pt, before, cost, after FROM n{i} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY cost, pt) = 1)""")
        move = "0" if i + 1 < len(grids) else f"coalesce(CASE WHEN before - 2 * cost + after > 0 THEN {step!r}::DOUBLE * (before - after) / (2 * (before - 2 * cost + after)) END, 0)"
        parts.append(f"p{i} AS (SELECT {keys}, size, mean, top, pt + {move} AS w FROM b{i})")
        from_ = f"p{i}"
    last = f"({em1.format(w='w')})"
    parts.append(f"""ts AS (SELECT {keys}, any_value(p.w) AS w, any_value(mean) AS mean, any_value(top) AS top, sum(x.n * ({l1p.format(x=f'{last} / p.top * x.y')})) / any_value(size) AS m
   FROM {src} x JOIN {from_} p USING ({keys}) GROUP BY {keys}),
 tail AS (SELECT {keys}, CASE WHEN abs(w) < 1e-12 OR abs({xi}) < {xi_eps} THEN 0 ELSE {xi} END AS xi,
   CASE WHEN abs(w) < 1e-12 OR abs({xi}) < {xi_eps} THEN greatest(mean, 1e-9) ELSE greatest(({xi}) * top / {last}, 1e-9) END AS beta, 'mle' AS estimator FROM ts)""")
    return ", ".join(parts)


@query("t15_spot_threshold", f"""WITH {GAP}, sr AS (SELECT op_category, delta_seconds, row_number() OVER (PARTITION BY op_category ORDER BY row_index) AS i, count(*) OVER (PARTITION BY op_category) AS n FROM gap WHERE delta_seconds IS NOT NULL),
 sc AS (SELECT * FROM sr WHERE i <= least(greatest(ceil(n * 0.8), 21), n)),
 st AS (SELECT op_category, 'upper' AS side, delta_seconds AS x FROM sc UNION ALL SELECT op_category, 'lower', -delta_seconds FROM sc),
 su AS (SELECT op_category, side, quantile_cont(x, 0.98) AS u, count(*) AS n FROM st GROUP BY ALL),
 sy AS (SELECT st.op_category, st.side, x - u AS y, count(*) AS n FROM st JOIN su USING (op_category, side) WHERE x > u GROUP BY ALL),
 se AS (SELECT op_category, side, sum(n)::BIGINT AS n_exc FROM sy GROUP BY ALL),
 sx AS (SELECT sy.* FROM sy JOIN se USING (op_category, side) WHERE n_exc >= 20), {_tail_fit_sql('op_category, side', 'sx', (-0.49, 10.0), 1e-8)},
 sl AS (SELECT su.*, xi, beta, coalesce(n_exc, 0) / su.n AS p FROM su LEFT JOIN se USING (op_category, side) LEFT JOIN tail USING (op_category, side)),
 sq AS (SELECT *, CASE WHEN xi IS NULL THEN NULL WHEN 1e-3 >= p THEN u WHEN abs(xi) < 1e-8 THEN u + beta * ln(p / 1e-3) ELSE u + beta / xi * (pow(p / 1e-3, xi) - 1) END AS tau FROM sl)
 SELECT op_category, max(n) AS n, round(max(tau) FILTER (side = 'upper'), 3) AS tau_hi, round(-max(tau) FILTER (side = 'lower'), 4) + 0.0 AS tau_lo,
   max(CASE WHEN xi IS NULL THEN side || '_insufficient_exceedances' END) AS reason FROM sq GROUP BY op_category""")
def _(spark, sf):
    found = G.spot_threshold(gaps(spark, sf).where("delta_seconds IS NOT NULL"), ["op_category"], "delta_seconds", calib_frac=0.8, index="row_index", min_exceed=20)
    return found.select("op_category", "n", F.round("tau_hi", 3).alias("tau_hi"), (F.round("tau_lo", 4) + F.lit(0.0)).alias("tau_lo"), "reason")


def _spot_rows(spark, sf):
    g = gaps(spark, sf).where("delta_seconds IS NOT NULL")
    return g.select("uid", "op_category", "row_index", "epoch_s", "delta_seconds", F.ln("delta_seconds").alias("log_dt"))


@query("t16_calibrate")
def _(spark, sf):
    return G.calibrate(_spot_rows(spark, sf), ["op_category"], "log_dt")


@query("t17_tail_fit", f"""WITH {GAP}, fu AS (SELECT op_category, quantile_cont(delta_seconds, 0.9) AS u FROM gap WHERE delta_seconds IS NOT NULL GROUP BY ALL),
 fy AS (SELECT gap.op_category, delta_seconds - u AS y, count(*) AS n FROM gap JOIN fu USING (op_category) WHERE delta_seconds > u GROUP BY ALL),
 {_tail_fit_sql('op_category', 'fy', G.XI_RANGE, 1e-6)} SELECT op_category, round(xi, 5) + 0.0 AS xi, round(beta, 2) AS beta, estimator FROM tail""")
def _(spark, sf):
    u = quantiles(_spot_rows(spark, sf), ["op_category"], "delta_seconds", {"u": 0.9})
    from ..scale import join_on, weighted

    over = join_on(_spot_rows(spark, sf), u, ["op_category"], "inner").where("delta_seconds > u")
    over = over.select("op_category", (F.col("delta_seconds") - F.col("u")).alias("y"))
    fit = G.fit_tails(weighted(over, ["op_category"], "y"), ["op_category"])
    return fit.select("op_category", (F.round("xi", 5) + F.lit(0.0)).alias("xi"), F.round("beta", 2).alias("beta"), "estimator")


def spot_entries(spark, sf, rows=None):
    return G.calibrate_tiers(_spot_rows(spark, sf) if rows is None else rows, "log_dt", min_tail=16)


@query("t18_spot_tiers")
def _(spark, sf):
    return spot_entries(spark, sf)


@query("t19_calibration_window", f"""WITH {GAP}, mx AS (SELECT min(epoch_s) a, max(epoch_s) b FROM gap), f AS (SELECT * FROM gap ORDER BY row_index LIMIT 4000)
  SELECT 'first' AS window_kind, count(*) AS n, round(avg(value),6) AS mean FROM f UNION ALL SELECT 'range', count(*), round(avg(value),6) FROM gap, mx WHERE epoch_s BETWEEN 1704500000 AND 1705500000 UNION ALL SELECT 'all', count(*), round(avg(value),6) FROM gap""")
def _(spark, sf):
    g = gaps(spark, sf)
    parts = {
        "first": G.calibration_rows(g, first=4000),
        "range": G.calibration_rows(g, between=(1704500000.0, 1705500000.0)),
        "all": G.calibration_rows(g),
    }
    from ..scale import union_all

    return union_all(
        [d.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean")).withColumn("window_kind", F.lit(k)) for k, d in parts.items()]
    )


_T20 = f"""{_LOGS}, {_gated('src')}, rq AS (SELECT g, count(*) AS n, quantile_cont(x,0.995) AS hi FROM src GROUP BY g)"""


@query("t20_method_chain", f"""WITH {_T20} SELECT g AS uid, rq.n, round(CASE WHEN rq.n<55 THEN NULL WHEN reason IS NULL THEN tau0 ELSE hi END,6)+0.0 AS tau_hi, CASE WHEN rq.n<55 OR reason IS NULL THEN 'otsu' ELSE 'quantile' END AS applied_method,
   CASE WHEN rq.n<55 THEN 'backoff' ELSE 'ok' END AS status, CASE WHEN rq.n<55 THEN 'insufficient_samples' END AS reason FROM rq JOIN og USING (g)""")
def _(spark, sf):
    t = H.resolve_method(_log_gaps(spark, sf), ["uid"], "x", "otsu", ["quantile"], n_min=55, side="upper")
    return t.select("uid", "n", *_cols("tau_hi"), "applied_method", "status", "reason")


@query("t21_hierarchy", f"""WITH {GAP}, a AS (SELECT uid, op_category, count(delta_seconds) n, quantile_cont(delta_seconds,0.995) hi, quantile_cont(delta_seconds,0.005) lo FROM gap GROUP BY uid, op_category), b AS (SELECT uid, count(delta_seconds) n, quantile_cont(delta_seconds,0.995) hi, quantile_cont(delta_seconds,0.005) lo FROM gap GROUP BY uid), c AS (SELECT count(delta_seconds) n, quantile_cont(delta_seconds,0.995) hi, quantile_cont(delta_seconds,0.005) lo FROM gap)
  SELECT a.uid, a.op_category, CASE WHEN a.n>=25 THEN 'uid::op_category' WHEN b.n>=60 THEN 'uid' ELSE 'global' END AS group_level, CASE WHEN a.n>=25 THEN a.n WHEN b.n>=60 THEN b.n ELSE c.n END AS n,
   round(CASE WHEN a.n>=25 THEN a.hi WHEN b.n>=60 THEN b.hi ELSE c.hi END,6) AS tau_hi, round(CASE WHEN a.n>=25 THEN a.lo WHEN b.n>=60 THEN b.lo ELSE c.lo END,6) AS tau_lo,
   CASE WHEN a.n>=25 THEN NULL WHEN b.n>=60 THEN 'backoff_to_uid' ELSE 'backoff_to_global' END AS reason FROM a JOIN b USING (uid) CROSS JOIN c""".replace("b.n>=60", "b.n>=25"))
def _(spark, sf):
    t = H.resolve_hierarchy(gaps(spark, sf), ["uid", "op_category"], "delta_seconds", n_min=25)
    return t.select("uid", "op_category", "group_level", "n", *_cols("tau_hi", "tau_lo"), "reason")


_T22 = f"""{EV}, pr0 AS (SELECT *, lag(epoch_s) OVER w pt, lag(uid) OVER w pu, lag(op_category) OVER w pc FROM (SELECT row_index, CAST(CAST(uid AS INTEGER)%4 AS VARCHAR) AS uid, op_category, epoch_s FROM ev) WINDOW w AS (ORDER BY row_index)),
 pr AS (SELECT *, epoch_s-pt>=0 AS hg, CASE WHEN epoch_s-pt>=0 THEN greatest(epoch_s-pt,1e-6) ELSE 0.0 END AS obs, NOT coalesce(uid=pu AND op_category=pc,FALSE) AS boundary FROM pr0),
 gl AS (SELECT count(*) n, greatest(quantile_cont(obs,0.99),0) hi, quantile_cont(obs,0.01) lo FROM pr WHERE hg),
 gg AS (SELECT uid, op_category, count(*) n, quantile_cont(obs,0.99) hi, quantile_cont(obs,0.01) lo FROM pr WHERE NOT boundary AND hg GROUP BY uid, op_category),
 th AS (SELECT gg.uid, gg.op_category, gg.n, greatest(CASE WHEN gg.n>=200 THEN gg.hi ELSE gl.hi END,0) AS tau_hi, CASE WHEN gg.n>=200 THEN gg.lo ELSE gl.lo END AS lo0, gg.n<200 AS fallback FROM gg CROSS JOIN gl),
 th2 AS (SELECT uid, op_category, n, tau_hi, greatest(least(lo0,tau_hi),0) AS tau_lo, fallback FROM th UNION ALL SELECT NULL, NULL, n, hi, greatest(least(lo,hi),0), TRUE FROM gl)"""


def _detector(spark, sf):
    e = events(spark, sf).select("row_index", (F.col("uid").cast("int") % 4).cast("string").alias("uid"), "op_category", "epoch_s")
    pairs = H.same_kind_gaps(e)
    return pairs, H.detector_thresholds(pairs, min_samples=200)


@query("t22_detector_thresholds", f"WITH {_T22} SELECT uid, op_category, n, {_sql('tau_hi','tau_lo')}, fallback FROM th2")
def _(spark, sf):
    _, t = _detector(spark, sf)
    return t.select("uid", "op_category", "n", *_cols("tau_hi", "tau_lo"), "fallback")


@query("c8_detector_scores", f"""WITH {_T22}, sc AS (SELECT p.row_index, p.obs, p.boundary, coalesce(t.tau_hi,g.hi) AS h, coalesce(t.tau_lo,greatest(least(g.lo,g.hi),0)) AS l FROM pr p CROSS JOIN gl g LEFT JOIN th2 t ON t.uid=p.uid AND t.op_category=p.op_category)
  SELECT row_index, round(CASE WHEN NOT boundary AND obs>h THEN obs-h WHEN NOT boundary AND obs<l THEN l-obs ELSE 0 END,6)+0.0 AS score, round(CASE WHEN NOT boundary AND obs>h THEN obs/greatest(h,1e-9) WHEN NOT boundary AND obs<l THEN greatest(l,1e-9)/greatest(obs,1e-9) ELSE 1 END,6)+0.0 AS s_q, NOT boundary AND (obs>h OR obs<l) AS flag FROM sc""")
def _(spark, sf):
    pairs, t = _detector(spark, sf)
    return H.score_pairs(pairs, t).select("row_index", *_cols("score", "s_q"), "flag")


@query("t23_mean_plus_sigma", f"WITH {SCO} SELECT uid, count(score_a) AS n, round(avg(score_a)+2*stddev_pop(score_a),6) AS tau FROM sco WHERE label=0 GROUP BY uid")
def _(spark, sf):
    return H.mean_plus_sigma(scored(spark, sf).where("label = 0"), ["uid"], "score_a", 2.0).select("uid", "n", *_cols("tau"))
