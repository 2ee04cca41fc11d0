"""Queries over scores, sequences, joins, evaluation and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tails as P
from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import scoring as S
from ..operators import sequences as Q
from ..operators import splits as G
from ..operators import statistics as T
from ..operators.sessions import session_gaps, session_table
from ..scale import attach, durable, join_on
from .cross_validation import cross_validate
from .registry import query
from .threshold_queries import _TIERS, _spot_rows, quantile_stats, spot_entries
from .views import EV, GAP, SCO, SES, events, gaps, r6, scored, sessions, table


def _cols(*names):
    return [r6(n).alias(n) for n in names]


def _sql(*names):
    return ", ".join(f"round({n},6)+0.0 AS {n}" for n in names)


# scoring ----------------------------------------------------------------------


def _with_quantiles(spark, sf):
    g = gaps(spark, sf).where("delta_seconds IS NOT NULL")
    stats = quantile_stats(spark, sf).withColumn("points", S.closed_points(F.col("cdf")))
    return T.lookup(g, durable(stats), ["tau_hi", "tau_lo", "points"])


_PTS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def _tier_points(name, level, key):
    from .threshold_queries import _d, _simple_sql, _tier

    pts = ", ".join(f"{_simple_sql('', '', _d(p))} AS v{i}" for i, p in enumerate(_PTS))
    return f"{name} AS (SELECT uid, op_category, max(n) AS n, {pts} FROM {_tier(level, key)} GROUP BY uid, op_category)"


_C1 = f"""{GAP}, {_tier_points('tg','group','uid, op_category')}, {_tier_points('tu','user','uid')}, {_tier_points('tw','global','')},
 pick AS (SELECT a.row_index, a.delta_seconds AS x, """ + ", ".join(
    f"CASE WHEN tg.n>=14 THEN tg.v{i} WHEN tu.n>=14 THEN tu.v{i} ELSE tw.v{i} END AS v{i}" for i in range(7)
) + """ FROM gap a JOIN tg ON tg.uid=a.uid AND tg.op_category=a.op_category JOIN tu ON tu.uid=a.uid CROSS JOIN tw WHERE a.delta_seconds IS NOT NULL),
 pp AS (SELECT *, v0-greatest(abs(v0)*1e-6,1e-9) AS lo, v6+greatest(abs(v6)*1e-6,1e-9) AS hi FROM pick)"""


def _cdf_sql():
    pts = [("lo", 0.0)] + [(f"v{i}", p) for i, p in enumerate(_PTS)] + [("hi", 1.0)]
    out = "CASE WHEN x<=lo THEN 0.0"
    for (a, pa), (b, pb) in zip(pts, pts[1:]):
        out += f" WHEN x<={b} THEN {pa}+(x-{a})/({b}-{a})*({pb}-{pa})"
    return f"CAST({out} ELSE 1.0 END AS DOUBLE)"


@query("c1_empirical_cdf", f"WITH {_C1} SELECT row_index, round({_cdf_sql()},6)+0.0 AS p_lower FROM pp")
def _(spark, sf):
    rows = _with_quantiles(spark, sf)
    return rows.select("row_index", r6(S.cdf_position(F.col("delta_seconds"), F.col("points"))).alias("p_lower"))


@query("c2_breach_severity", f"""WITH {_TIERS} SELECT a.row_index, round(CASE WHEN a.delta_seconds>r.tau_hi THEN a.delta_seconds/greatest(r.tau_hi,1e-9) WHEN a.delta_seconds<r.tau_lo THEN greatest(abs(r.tau_lo),1e-9)/greatest(a.delta_seconds,1e-9) ELSE 1 END,6)+0.0 AS s_q
  FROM gap a JOIN res r ON r.uid=a.uid AND r.op_category=a.op_category WHERE a.delta_seconds IS NOT NULL""")
def _(spark, sf):
    rows = _with_quantiles(spark, sf)
    s = S.breach_severity(F.col("delta_seconds"), F.col("tau_hi"), F.col("tau_lo"))
    return rows.select("row_index", r6(s).alias("s_q"))


@query("c3_tail_probability", f"""WITH {EV}, t AS (SELECT row_index, greatest(value-40,0.0) AS y, CASE k%4 WHEN 0 THEN -0.2 WHEN 1 THEN 0.0 WHEN 2 THEN 0.15 ELSE 1e-13 END AS xi FROM ev)
  SELECT row_index, round(-log10(greatest(0.1*CASE WHEN y<=0 THEN 1.0 WHEN abs(xi)<1e-12 THEN exp(-y/25.0) WHEN 1+xi*y/25.0<=0 THEN 0.0 ELSE pow(1+xi*y/25.0,-1/xi) END,1e-300)),6)+0.0 AS score FROM t""")
def _(spark, sf):
    k = F.col("k")
    xi = F.when(k % 4 == 0, -0.2).when(k % 4 == 1, 0.0).when(k % 4 == 2, 0.15).otherwise(1e-13)
    y = F.greatest(F.col("value") - 40, F.lit(0.0))
    return events(spark, sf).select("row_index", r6(P.neg_log10(P.tail_probability(y, xi, 25.0, 0.1))).alias("score"))


@query("c4_adaptive_level", f"""WITH {EV}, t AS (SELECT row_index, CASE k%4 WHEN 0 THEN -0.2 WHEN 1 THEN 0.0 WHEN 2 THEN 0.15 ELSE 1e-13 END AS xi, 0.0005+k/2000.0 AS q FROM ev),
  v AS (SELECT row_index, xi, CASE WHEN abs(xi)<1e-12 THEN 3+0.7*ln(greatest(0.01/greatest(q,1e-12),1e-12)) ELSE 3+0.7/xi*(pow(greatest(0.01/greatest(q,1e-12),1e-12),xi)-1) END AS l FROM t)
  SELECT row_index, round(CASE WHEN xi<0 THEN least(greatest(l,3),3-0.7/xi) ELSE greatest(l,3) END,6)+0.0 AS level FROM v""")
def _(spark, sf):
    k = F.col("k")
    xi = F.when(k % 4 == 0, -0.2).when(k % 4 == 1, 0.0).when(k % 4 == 2, 0.15).otherwise(1e-13)
    level = P.adaptive_level(3.0, xi, 0.7, 0.01, 0.0005 + k / 2000.0)
    return events(spark, sf).select("row_index", r6(level).alias("level"))


@query("c5_alarm_reason", f"""WITH {_TIERS}, j AS (SELECT a.row_index, a.delta_seconds x, r.tau_hi h, r.tau_lo l, a.k%7=0 AS latched FROM gap a JOIN res r ON r.uid=a.uid AND r.op_category=a.op_category WHERE a.delta_seconds IS NOT NULL),
  q AS (SELECT *, CASE WHEN x>h THEN 'quantile_upper' WHEN x<l THEN 'quantile_lower' ELSE '' END AS q FROM j) SELECT row_index, CASE WHEN latched AND q='' THEN 'spot_upper' WHEN latched THEN 'both' ELSE q END AS alarm_reason FROM q""")
def _(spark, sf):
    rows = _with_quantiles(spark, sf)
    r = S.alarm_reason(F.col("delta_seconds"), F.col("tau_hi"), F.col("tau_lo"), F.col("k") % 7 == 0)
    return rows.select("row_index", r.alias("alarm_reason"))


@query("c5_scored_rows")
def _(spark, sf):
    rows = durable(_spot_rows(spark, sf))  # read by both fits and scored
    return S.score_rows(rows, durable(quantile_stats(spark, sf, rows)), durable(spot_entries(spark, sf, rows)))


@query("c6_reestimate")
def _(spark, sf):
    from ..operators.tailfit import calibrate, reestimate

    rows = _spot_rows(spark, sf)
    first = durable(calibrate(rows, ["op_category"], "log_dt", min_tail=20))
    size = rows.count() // 6
    return reestimate(rows, first, ["op_category"], "log_dt", every=max(size, 50), min_tail=20)


@query("c7_decluster", f"""WITH RECURSIVE {EV}, b AS (SELECT op_category, quantile_cont(value,0.6) AS u FROM ev GROUP BY 1), x AS (SELECT op_category, row_index, value FROM ev JOIN b USING (op_category) WHERE value>u),
  k AS (SELECT op_category, min(row_index) AS row_index FROM x GROUP BY 1 UNION ALL SELECT k.op_category, min(x.row_index) FROM k JOIN x ON x.op_category=k.op_category AND x.row_index>k.row_index+25 GROUP BY k.op_category)
  SELECT op_category, row_index, value FROM k JOIN x USING (op_category, row_index)""")
def _(spark, sf):
    from ..operators.tailfit import decluster
    from ..scale import quantiles

    e = events(spark, sf).select("op_category", "row_index", "value")
    above = attach(e, quantiles(e, ["op_category"], "value", {"u": 0.6}), ["op_category"], "inner").where("value > u").drop("u")
    return decluster(above, ["op_category"], "row_index", 25)


@query("c9_apply_thresholds", f"""WITH {GAP}, t AS (SELECT uid, quantile_cont(delta_seconds,0.95) hi, quantile_cont(delta_seconds,0.05) lo FROM gap WHERE CAST(uid AS INTEGER)%3<>0 GROUP BY uid), g AS (SELECT quantile_cont(delta_seconds,0.95) hi, quantile_cont(delta_seconds,0.05) lo FROM gap)
  SELECT row_index, round(coalesce(t.hi,g.hi),6) AS tau_hi, round(coalesce(t.lo,g.lo),6) AS tau_lo, CAST(coalesce(delta_seconds>=coalesce(t.hi,g.hi),FALSE) OR coalesce(delta_seconds<=coalesce(t.lo,g.lo),FALSE) AS INTEGER) AS anomaly_label FROM gap CROSS JOIN g LEFT JOIN t USING (uid)""")
def _(spark, sf):
    from ..operators.thresholds import quantile_threshold

    g = gaps(spark, sf)
    own = quantile_threshold(g.where(F.col("uid").cast("int") % 3 != 0), ["uid"], "delta_seconds", 0.05)
    glob = quantile_threshold(g, [], "delta_seconds", 0.05)
    t = own.unionByName(glob, allowMissingColumns=True)
    return S.apply_thresholds(g, t, ["uid"], "delta_seconds").select("row_index", *_cols("tau_hi", "tau_lo"), "anomaly_label")


_HZ = f"""{GAP}, rt AS (SELECT uid, ln(1/avg(delta_seconds)) AS g FROM gap GROUP BY uid), hz0 AS (SELECT row_index, uid, epoch_s, delta_seconds AS d, g, 1e-6*(k%5) AS w, k%9=0 AS cens FROM gap JOIN rt USING (uid) WHERE delta_seconds IS NOT NULL),
 hz AS (SELECT *, exp(-CASE WHEN w<=1e-6 THEN exp(g)*d ELSE exp(g)*(exp(w*d)-1)/w END) AS survival, CASE WHEN w<=1e-6 THEN -ln(0.1)/exp(g) ELSE ln(1+(-w*ln(0.1)*exp(-g)))/w END AS tau_q FROM hz0),
 hr AS (SELECT *, coalesce(d/tau_q,0) AS ratio, NOT cens AND survival<=0.1 AS raw_alarm FROM hz),
 hv AS (SELECT *, CAST(sum(CASE WHEN raw_alarm THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS INTEGER) AS votes FROM hr),
 hm AS (SELECT *, CASE WHEN votes>=2 THEN 1 WHEN ratio<=1/1.1 THEN 0 END AS mark FROM hv)"""


def _hazard_rows(spark, sf):
    g = gaps(spark, sf)
    rows = join_on(g, T.rate_table(g, ["uid"]).select("uid", "g"), ["uid"])
    return rows.where("delta_seconds IS NOT NULL").withColumns({"w": F.lit(1e-6) * (F.col("k") % 5), "cens": F.col("k") % 9 == 0})


@query("c10_hazard_scores", f"""WITH {_HZ} SELECT row_index, {_sql('survival','ratio')}, raw_alarm, round(CASE WHEN raw_alarm THEN greatest(d-tau_q,0) END,4)+0.0 AS lead_time, votes,
  coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY uid ORDER BY epoch_s, row_index ROWS UNBOUNDED PRECEDING),0)=1 AS alarm FROM hm""")
def _(spark, sf):
    out = S.hazard_scores(
        _hazard_rows(spark, sf), F.col("g"), F.col("w"), "delta_seconds", ["uid"], ["epoch_s", "row_index"],
        q=0.1, censored=F.col("cens"), k=2, n=5,
    )
    lead = (F.round("lead_time", 4) + F.lit(0.0)).alias("lead_time")
    return out.select("row_index", *_cols("survival", "ratio"), "raw_alarm", lead, "votes", "alarm")


_PAIR = f"""{EV}, pr0 AS (SELECT *, lag(event) OVER w AS context, epoch_s-lag(epoch_s) OVER w AS delta FROM ev WINDOW w AS (PARTITION BY uid ORDER BY epoch_s, row_index)),
 pr AS (SELECT uid, epoch_s, row_index, context, event AS target, delta FROM pr0 WHERE context IS NOT NULL),
 tc AS (SELECT context, target, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY context) AS p FROM pr GROUP BY context, target),
 tk AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY p DESC, target) AS rk FROM tc), tm AS (SELECT context, least(1.0, sum(p) FILTER (rk<=2)) AS mass FROM tk GROUP BY context)"""


def _pairs(spark, sf):
    return Q.next_event_pairs(events(spark, sf), ["uid"], ["epoch_s", "row_index"])


def _trans(spark, sf):
    return durable(T.transitions(events(spark, sf), ["uid"], ["epoch_s", "row_index"], "event"))


@query("w13_next_event_pairs", f"WITH {_PAIR} SELECT uid, row_index, context, target, round(delta,6)+0.0 AS delta, FALSE AS censored FROM pr")
def _(spark, sf):
    return _pairs(spark, sf).select("uid", "row_index", "context", "target", *_cols("delta"), "censored")


@query("w13_turn_pairs", """WITH r AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, coalesce(p,'<bos>') AS context, role AS target FROM r""")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("t", F.col("turn").cast("double"))
    out = Q.next_event_pairs(c, ["conv_id"], ["turn"], event="role", epoch="t", bos=True)
    return out.select("conv_id", "turn", "context", "target")


@query("c11_event_surprise", f"""WITH {_PAIR} SELECT pr.row_index, round(tm.mass,6)+0.0 AS topk_mass, round(1-tm.mass,6)+0.0 AS p_ev, CASE WHEN tk.rk<=2 THEN 1 ELSE 0 END AS topk_hit, CAST(CASE WHEN tk.rk<=2 THEN tk.rk END AS INTEGER) AS topk_rank
  FROM pr JOIN tm USING (context) JOIN tk ON tk.context=pr.context AND tk.target=pr.target""")
def _(spark, sf):
    s = Q.surprise(_pairs(spark, sf), _trans(spark, sf), k=2)
    return s.select("row_index", *_cols("topk_mass", "p_ev"), "topk_hit", "topk_rank")


@query("c12_event_time_fisher", f"""WITH {_PAIR}, rt AS (SELECT ln(1/avg(delta)) AS g FROM pr), f AS (SELECT row_index, least(greatest(mass,1e-12),1-1e-12) AS m, least(greatest(exp(-exp(g)*delta),1e-12),1-1e-12) AS s FROM pr JOIN tm USING (context), rt),
  h AS (SELECT row_index, -2*ln(m)-2*ln(s) AS x FROM f) SELECT row_index, round(x,6)+0.0 AS fisher_statistic, round(-log10(greatest(exp(-x/2)*(1+x/2),1e-300)),6)+0.0 AS neglog10_p FROM h""")
def _(spark, sf):
    pairs = _pairs(spark, sf)
    s = Q.surprise(pairs, _trans(spark, sf), k=2)
    s = attach(s, T.rate_table(pairs, [], "delta").select("g"), [])
    s = s.withColumn("p_time", 1 - P.hazard_survival(F.col("g"), 0.0, F.col("delta")))
    out = s.withColumns(Q.combine_event_time(F.col("topk_mass"), F.col("p_time"), F.col("censored")))
    return out.select("row_index", *_cols("fisher_statistic", "neglog10_p"))


_FIS = """, fz0 AS (SELECT *, least(greatest(pow(10.0,-score_a),1e-300),1.0) AS pa, least(greatest(pow(10.0,-score_b),1e-300),1.0) AS pb FROM sco),
 fz AS (SELECT *, -log10(greatest(least(exp((ln(pa)+ln(pb)))*(1-(ln(pa)+ln(pb))),1.0),1e-300)) AS fused FROM fz0)"""


@query("c13_fused_scores", f"WITH {SCO}{_FIS} SELECT row_index, round(fused,6)+0.0 AS fused FROM fz")
def _(spark, sf):
    return scored(spark, sf).select("row_index", r6(S.fuse(F.col("score_a"), F.col("score_b"))).alias("fused"))


@query("c13_weighted_fusion")
def _(spark, sf):
    return scored(spark, sf).select("row_index", S.fuse(F.col("score_a"), F.col("score_b"), (0.7, 1.6)).alias("fused"))


def _method_rows(spark, sf):
    s = scored(spark, sf)
    return E.by_method(s, {"a": "score_a", "b": "score_b"}, ["row_index", "uid", "session_id", "epoch_s", "label"])


_MET = SCO + """, mr AS (SELECT row_index, uid, session_id, epoch_s, label, 'a' AS method, score_a AS score FROM sco UNION ALL SELECT row_index, uid, session_id, epoch_s, label, 'b', score_b FROM sco),
 sc AS (SELECT method, score, sum(label) AS pos, sum(1-label) AS neg FROM mr GROUP BY 1,2),
 cv AS (SELECT method, score AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method) AS p, sum(neg) OVER (PARTITION BY method) AS n FROM sc WINDOW w AS (PARTITION BY method ORDER BY score DESC))"""


@query("c14_f1_alarms", f"""WITH {_MET}, val AS (SELECT * FROM cv), b AS (SELECT method, arg_max(threshold, struct_pack(a := round(2*tp/(tp+fp+p),12), b := threshold)) AS threshold FROM cv GROUP BY method)
  SELECT row_index, method, CAST(score>=threshold AS INTEGER) AS alarm FROM mr JOIN b USING (method)""")
def _(spark, sf):
    m = _method_rows(spark, sf)
    cal = E.best_f1(E.score_curve(m, ["method"], "score", "label"), ["method"], "larger")
    return S.apply_calibration(m, cal, ["method"], "score").select("row_index", "method", "alarm")


@query("c14_budget_alarms", f"""WITH {_MET}, rk AS (SELECT method, score, row_number() OVER (PARTITION BY method ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY method) AS n FROM mr), b AS (SELECT method, max(score) FILTER (rn=floor(n*0.05)) AS threshold FROM rk GROUP BY method)
  SELECT method, any_value(threshold) AS threshold, count(*) AS n, CAST(sum(CAST(score>=threshold AS INTEGER)) AS BIGINT) AS alarms FROM mr JOIN b USING (method) GROUP BY method""")
def _(spark, sf):
    m = _method_rows(spark, sf)
    cal = S.budget_threshold(m, ["method"], "score", 0.05)
    out = S.apply_calibration(m, cal, ["method"], "score").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("alarm").alias("alarms"))
    return out.join(cal.select("method", "threshold"), "method").select("method", "threshold", "n", "alarms")


@query("c15_sequence_score", f"""WITH {_PAIR}, mu AS (SELECT context, avg(delta) AS m FROM pr GROUP BY context), q AS (SELECT pr.*, -ln(tc.p)+abs(delta-m) AS score FROM pr JOIN tc ON tc.context=pr.context AND tc.target=pr.target JOIN mu ON mu.context=pr.context),
  t AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY uid) AS n, first_value(score) OVER w AS f, sum(score) OVER (PARTITION BY uid ORDER BY epoch_s,row_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM q WINDOW w AS (PARTITION BY uid ORDER BY epoch_s, row_index))
  SELECT row_index, round(score,4)+0.0 AS score, round(CASE WHEN n<5 THEN score ELSE (s+greatest(5-rn,0)*f)/5 END,4)+0.0 AS smoothed FROM t""")
def _(spark, sf):
    out = Q.sequence_score(_pairs(spark, sf), _trans(spark, sf), ["uid"], ["epoch_s", "row_index"])
    return out.select("row_index", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("score", "smoothed")])


@query("c16_session_vote", f"WITH {SES} SELECT sid, count(*) AS events, count(*) FILTER (value>60) AS exceeding, count(*) FILTER (value>60)>=2 AS anomalous FROM ses GROUP BY sid")
def _(spark, sf):
    return S.session_vote(sessions(spark, sf), "sid", "value", 60.0, 2)


# joins, sets, sorts -----------------------------------------------------------


@query("j1_join_scores", f"WITH {SCO} SELECT row_index, score_a, score_b, label FROM sco")
def _(spark, sf):
    s = scored(spark, sf)
    return J.joined_scores(s.select("row_index", "label"), [s.select("row_index", "score_a"), s.select("row_index", "score_b")])


@query("j1_join_report", f"""WITH {EV}, b AS (SELECT row_index//2 AS row_index FROM ev WHERE k%10=0 UNION ALL SELECT row_index FROM ev WHERE k%10<>0), a AS (SELECT row_index FROM ev), u AS (SELECT row_index, sum(a) a, sum(b) b FROM (SELECT row_index, 1 AS a, 0 AS b FROM a UNION ALL SELECT row_index, 0, 1 FROM b) GROUP BY 1)
  SELECT count(*) FILTER (a>1) AS repeated_left, count(*) FILTER (b>1) AS repeated_right, count(*) FILTER (a>0 AND b=0) AS unmatched FROM u""")
def _(spark, sf):
    e = events(spark, sf)
    i = F.col("row_index")
    b = e.select(F.when(F.col("k") % 10 == 0, F.floor(i / 2)).otherwise(i).alias("row_index"))
    return J.join_report(e.select("row_index"), b)


@query("j2_truth_predictions", f"WITH {SES} SELECT uid, sid, session_index AS step, label AS label_truth, CAST(value>50 AS INTEGER) AS label_pred, value FROM ses")
def _(spark, sf):
    s = sessions(spark, sf).withColumn("step", F.col("session_index"))
    pred = s.select("uid", "sid", "step", (F.col("value") > 50).cast("int").alias("label"), "value")
    return J.truth_with_predictions(s.select("uid", "sid", "step", "label"), pred, ["uid", "sid", "step"])


@query("j3_add_features", f"WITH {EV}, f AS (SELECT uid, op_category, arg_min(value,row_index) AS first_value FROM ev GROUP BY uid, op_category) SELECT e.row_index, f.first_value FROM ev e LEFT JOIN f ON f.uid=e.uid AND f.op_category=e.op_category")
def _(spark, sf):
    e = events(spark, sf)
    extra = e.select("uid", "op_category", F.col("value").alias("first_value"), F.col("row_index").alias("source_order"))
    out = J.add_features(e.select("row_index", "uid", "op_category"), extra, ["uid", "op_category"], "source_order")
    return out.select("row_index", "first_value")


@query("j5_aligned_report", f"WITH {GAP} SELECT count(*) AS rows, count(*) FILTER (time_label='initial') AS unmatched, count(*) FILTER (time_label<>'initial' AND label=1) AS different FROM gap")
def _(spark, sf):
    g = gaps(spark, sf)
    scored_rows = g.where("time_label <> 'initial'").withColumn("value", F.col("value") + F.col("label"))
    return J.aligned_report(g, scored_rows, ["uid", "value"])


def _session_rows(spark, sf):
    return session_table(sessions(spark, sf), session="sid")


_ST = SES + """, st AS (SELECT sid AS session_id, any_value(uid) AS grp, min(epoch_s) AS start_s, max(epoch_s) AS end_s, count(*) AS events, sum(label) AS pos FROM ses GROUP BY sid),
 rk AS (SELECT *, row_number() OVER (ORDER BY start_s, session_id)-1 AS rank, count(*) OVER () AS total FROM st)"""


def _roll(spark, sf):
    s = durable(_session_rows(spark, sf))
    n = s.count()
    return G.rolling_origin(G.ordered_sessions(s), train=n // 2, val=n // 10, test=n // 10, step=n // 10, purge=20, embargo=30)


_G2 = _ST + """, fd AS (SELECT unnest(range(9)) AS fold), fe AS (SELECT fold, rk.*, total//2+fold*(total//10) AS te, total//10 AS v FROM rk CROSS JOIN fd), ra AS (SELECT * FROM (SELECT *, CASE WHEN rank<te-30 THEN 'train' WHEN rank>=te+20 AND rank<te+20+v THEN 'validation' WHEN rank>=te+20+v AND rank<te+20+2*v THEN 'test' END AS role FROM fe WHERE te+20+2*v<=total) WHERE role IS NOT NULL)"""


@query("j6_fold_events", f"WITH {_G2} SELECT row_index, uid, sid FROM ses WHERE sid IN (SELECT session_id FROM ra WHERE fold=1 AND role='validation')")
def _(spark, sf):
    ev = sessions(spark, sf)
    a = _roll(spark, sf).withColumnRenamed("session_id", "sid")
    return J.rows_of_fold(ev, a, 1, "validation", "sid").select("row_index", "uid", "sid")


@query("j7_group_antijoin", f"WITH {_ST} SELECT session_id FROM st WHERE grp NOT IN (SELECT grp FROM rk WHERE rank>=total-total//30)")
def _(spark, sf):
    r = G.ordered_sessions(_session_rows(spark, sf))
    held = r.where(F.col("rank") >= F.col("total") - F.floor(F.col("total") / 30))
    return J.without_groups(r, held, ["group"]).select("session_id")


@query("j8_merged_intervals", f"""WITH {_G2}, i AS (SELECT start_s-60 AS s, end_s+120 AS e FROM ra WHERE role='validation'), r AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
  g AS (SELECT s, e, sum(CASE WHEN reach IS NULL OR s>reach THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r) SELECT min(s) AS start_s, max(e) AS end_s FROM g GROUP BY g""")
def _(spark, sf):
    return J.merged_intervals(_fences(spark, sf), "start_s", "end_s")


def _fences(spark, sf):
    r = _roll(spark, sf).where("role = 'validation'")
    return r.select((F.col("start_s") - 60).alias("start_s"), (F.col("end_s") + 120).alias("end_s"))


@query("j8_interval_antijoin", f"WITH {_G2}, i AS (SELECT start_s-60 AS s, end_s+120 AS e FROM ra WHERE role='validation') SELECT row_index, uid FROM ses WHERE NOT EXISTS (SELECT 1 FROM i WHERE epoch_s>=s AND epoch_s<=e)")
def _(spark, sf):
    rows = events(spark, sf).select("row_index", "uid", "epoch_s")
    return J.outside_intervals(rows, _fences(spark, sf), "epoch_s").select("row_index", "uid")


@query("u1_stacked", f"WITH {EV} SELECT row_index, uid, NULL::DOUBLE AS value, 0 AS source_no FROM ev WHERE k<50 UNION ALL SELECT row_index, uid, value, 1 FROM ev WHERE k>=50")
def _(spark, sf):
    e = events(spark, sf)
    return J.stacked([e.where("k < 50").select("row_index", "uid"), e.where("k >= 50").select("row_index", "uid", "value")]).select(
        "row_index", "uid", "value", "source_no"
    )


@query("u2_overlap", f"WITH {EV} SELECT uid FROM ev WHERE event='purchase' INTERSECT SELECT uid FROM ev WHERE event='error'")
def _(spark, sf):
    e = events(spark, sf)
    return J.overlap(e.where("event = 'purchase'"), e.where("event = 'error'"), "uid")


@query("u3_distinct", f"WITH {EV} SELECT DISTINCT uid, op_category FROM ev")
def _(spark, sf):
    return J.distinct_entities(events(spark, sf), ["uid", "op_category"])


@query("o1_top_anomalies", f"WITH {EV} SELECT row_index, uid, value FROM ev WHERE label=1 ORDER BY value DESC, row_index LIMIT 20")
def _(spark, sf):
    return J.top_anomalies(events(spark, sf), "value").select("row_index", "uid", "value")


@query("o2_session_order", f"WITH {_ST} SELECT session_id, rank, total FROM rk")
def _(spark, sf):
    return G.ordered_sessions(_session_rows(spark, sf)).select("session_id", "rank", "total")


@query("o3_head_per_key", f"WITH {EV} SELECT row_index, uid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY epoch_s, row_index) AS rn FROM ev) WHERE rn<=3")
def _(spark, sf):
    return J.head_per_key(events(spark, sf), ["uid"], ["epoch_s", "row_index"], 3).select("row_index", "uid")


# evaluation ---------------------------------------------------------------------


@query("e1_confusion", f"""WITH {_MET}, c AS (SELECT method, uid, count(*) FILTER (label=1 AND score>0.5) tp, count(*) FILTER (label=0 AND score>0.5) fp, count(*) FILTER (label=1 AND score<=0.5) fn, count(*) FILTER (label=0 AND score<=0.5) tn FROM mr GROUP BY 1,2)
  SELECT method, uid, tp, fp, fn, tn, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6)+0.0 AS f1, round(tp/nullif(tp+fp,0),6)+0.0 AS precision, round(tp/nullif(tp+fn,0),6)+0.0 AS tpr, round(fp/nullif(fp+tn,0),6)+0.0 AS fpr FROM c""")
def _(spark, sf):
    m = _method_rows(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return E.confusion(m, ["method", "uid"], "label", "pred").select("method", "uid", "tp", "fp", "fn", "tn", *_cols("f1", "precision", "tpr", "fpr"))


@query("e2_boundary_agreement", f"""WITH {SES}, b AS (SELECT uid, CASE WHEN session_index=0 THEN 1 ELSE 0 END AS t, CASE WHEN coalesce(delta_seconds,1e9)>36000 THEN 1 ELSE 0 END AS p FROM ses),
  c AS (SELECT uid, count(*) FILTER (t=1 AND p=1) tp, count(*) FILTER (t=0 AND p=1) fp, count(*) FILTER (t=1 AND p=0) fn, count(*) FILTER (t=0 AND p=0) tn, count(*) n FROM b GROUP BY uid)
  SELECT uid, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1, round(tp/nullif(tp+fp+fn,0),6) AS jaccard, round(greatest(0,
   CASE WHEN tp>0 THEN -(tp/n)*(log2(tp/(tp+fn))+log2(tp/(tp+fp))) ELSE 0 END+CASE WHEN fp>0 THEN -(fp/n)*(log2(fp/(fp+tn))+log2(fp/(tp+fp))) ELSE 0 END
   +CASE WHEN fn>0 THEN -(fn/n)*(log2(fn/(tp+fn))+log2(fn/(fn+tn))) ELSE 0 END+CASE WHEN tn>0 THEN -(tn/n)*(log2(tn/(fp+tn))+log2(tn/(fn+tn))) ELSE 0 END),6)+0.0 AS variation_bits FROM c""")
def _(spark, sf):
    s = sessions(spark, sf).select(
        "uid", (F.col("session_index") == 0).cast("int").alias("t"),
        (F.coalesce("delta_seconds", F.lit(1e9)) > 36000).cast("int").alias("p"),
    )
    return E.boundary_agreement(s, ["uid"], "t", "p").select("uid", *_cols("f1", "jaccard", "variation_bits"))


@query("e3_e4_ranking_metrics", f"""WITH {_MET} SELECT method, CAST(max(p+n) AS BIGINT) AS rows, CAST(max(p) AS BIGINT) AS positives, round(sum(tp/(tp+fp)*pos)/max(p),6) AS average_precision, round(sum(pos*((n-fp)+neg/2))/(max(p)*max(n)),6) AS roc_auc FROM cv GROUP BY method""")
def _(spark, sf):
    c = E.score_curve(_method_rows(spark, sf), ["method"], "score", "label")
    return E.ranking_metrics(c, ["method"]).select("method", "rows", "positives", *_cols("average_precision", "roc_auc"))


@query("e3_quality_by_length", """WITH r AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT s, sum(y) pos, sum(1-y) neg FROM r GROUP BY s), c AS (SELECT *, sum(pos) OVER w tp, sum(neg) OVER w fp, sum(pos) OVER () p, sum(neg) OVER () n FROM g WINDOW w AS (ORDER BY s DESC))
  SELECT CAST(max(p) AS BIGINT) AS positives, round(sum(tp/(tp+fp)*pos)/max(p),6) AS average_precision, round(sum(pos*((n-fp)+neg/2))/(max(p)*max(n)),6) AS roc_auc FROM c""")
def _(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    c = E.score_curve(d, [], "n_chars", "quality")
    return E.ranking_metrics(c, []).select("positives", *_cols("average_precision", "roc_auc"))


@query("e3_precision_by_row", f"""WITH {_MET}, t AS (SELECT method, label, sum(label) OVER w AS tp, row_number() OVER w AS rn FROM mr WINDOW w AS (PARTITION BY method ORDER BY score DESC, row_index ROWS UNBOUNDED PRECEDING)) SELECT method, round(sum(CASE WHEN label=1 THEN tp/rn END)/sum(label),6) AS average_precision FROM t GROUP BY method""")
def _(spark, sf):
    out = E.average_precision_by_row(_method_rows(spark, sf), ["method"], "score", "label", "row_index")
    return out.select("method", *_cols("average_precision"))


@query("e5_pr_points", f"WITH {_MET} SELECT method, threshold, round(tp/(tp+fp),6) AS precision, round(tp/p,6)+0.0 AS recall FROM cv")
def _(spark, sf):
    c = E.score_curve(_method_rows(spark, sf), ["method"], "score", "label")
    return E.pr_points(c, ["method"]).select("method", "threshold", *_cols("precision", "recall"))


def _f1(order, extra=""):
    return f"""WITH {_MET}, cand AS (SELECT method, threshold, tp, fp, p FROM cv{extra}), f AS (SELECT *, 2*tp/(tp+fp+p) AS f1, row_number() OVER (PARTITION BY method ORDER BY round(2*tp/(tp+fp+p),12) DESC, threshold {order}) AS rn FROM cand)
  SELECT method, CASE WHEN threshold<>'-infinity'::DOUBLE THEN threshold END AS threshold, round(f1,6) AS f1, round(coalesce(tp/nullif(tp+fp,0),0),6) AS precision, round(tp/p,6) AS recall FROM f WHERE rn=1"""


for _name, _order, _extra in (
    ("larger", "DESC", ""),
    ("smaller", "ASC", " UNION ALL SELECT method, max(threshold)+1, 0, 0, max(p) FROM cv GROUP BY method"),
    ("extended", "ASC", " UNION ALL SELECT m.method, c.t, coalesce((SELECT max(tp) FROM cv WHERE cv.method=m.method AND cv.threshold>=c.t),0), coalesce((SELECT max(fp) FROM cv WHERE cv.method=m.method AND cv.threshold>=c.t),0), m.p FROM (SELECT method, max(p) AS p FROM cv GROUP BY method) m CROSS JOIN (SELECT unnest([1.0::DOUBLE,0.0,'-infinity'::DOUBLE]) AS t) c"),
):

    def _best(spark, sf, rule=_name):
        c = E.score_curve(_method_rows(spark, sf), ["method"], "score", "label")
        return E.best_f1(c, ["method"], rule).select("method", "threshold", *_cols("f1", "precision", "recall"))

    query(f"e6_best_f1_{_name}", _f1(_order, _extra))(_best)


_SEG = f"""{SES}, sp AS (SELECT uid, sid, epoch_s, row_index, CASE WHEN event IN ('error','click') THEN 1 ELSE 0 END AS y, CASE WHEN value>45 THEN 1 ELSE 0 END AS p FROM ses),
 s1 AS (SELECT *, lag(y) OVER (PARTITION BY sid ORDER BY epoch_s,row_index) AS py, min(CASE WHEN p=1 THEN epoch_s END) OVER (PARTITION BY sid ORDER BY epoch_s, row_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx,
   lag(sid) OVER (ORDER BY epoch_s, sid, row_index) AS gs, lag(y) OVER (ORDER BY epoch_s, sid, row_index) AS gy FROM sp)"""


def _seg_rows(spark, sf):
    return sessions(spark, sf).select(
        "uid", "sid", "epoch_s", "row_index", F.col("event").isin("error", "click").cast("int").alias("y"), (F.col("value") > 45).cast("int").alias("p")
    )


@query("w19_segments", f"WITH {_SEG} SELECT row_index, sid, round(greatest(nx-epoch_s,0),6)+0.0 AS delay_s FROM s1 WHERE y=1 AND coalesce(py,0)<>1 AND nx IS NOT NULL UNION ALL SELECT row_index, sid, NULL FROM s1 WHERE y=1 AND coalesce(py,0)<>1 AND nx IS NULL")
def _(spark, sf):
    return E.segments(_seg_rows(spark, sf), [], "y", "p", "sid").select("row_index", "sid", *_cols("delay_s"))


@query("w19_segments_interleaved", f"WITH {_SEG} SELECT row_index, sid FROM s1 WHERE y=1 AND NOT coalesce(gs=sid AND gy=1, FALSE)")
def _(spark, sf):
    return E.segments(_seg_rows(spark, sf), [], "y", "p", "sid", interleaved=True).select("row_index", "sid")


@query("e7_detection_delay", f"WITH {_SEG} SELECT uid, round(avg(CASE WHEN nx IS NOT NULL THEN greatest(nx-epoch_s,0) END),4)+0.0 AS mean_delay_s, count(*) AS segments, count(nx) AS detected FROM s1 WHERE y=1 AND coalesce(py,0)<>1 GROUP BY uid")
def _(spark, sf):
    s = E.segment_summary(E.segments(_seg_rows(spark, sf), ["uid"], "y", "p", "sid"), ["uid"])
    return s.select("uid", (F.round("mean_delay_s", 4) + F.lit(0.0)).alias("mean_delay_s"), "segments", "detected")


@query("e8_topk_accuracy", f"WITH {_PAIR} SELECT pr.context, round(avg(CASE WHEN tk.rk<=2 THEN 1 ELSE 0 END),6) AS topk_accuracy FROM pr JOIN tk ON tk.context=pr.context AND tk.target=pr.target GROUP BY pr.context")
def _(spark, sf):
    return E.topk_accuracy(Q.surprise(_pairs(spark, sf), _trans(spark, sf), 2), ["context"]).select("context", *_cols("topk_accuracy"))


@query("e9_gap_log_loss", f"""WITH {_HZ}, l AS (SELECT uid, greatest(w,1e-6) AS w, d, g, cens FROM hz0), m AS (SELECT uid, CASE WHEN w<=1e-6 THEN exp(g)*d ELSE exp(g)*(exp(w*d)-1)/w END AS i, g+w*d AS ll, cens FROM l) SELECT uid, round(avg(CASE WHEN cens THEN i ELSE i-ll END),6) AS neg_log_lik FROM m GROUP BY uid""")
def _(spark, sf):
    return E.gap_log_loss(_hazard_rows(spark, sf), ["uid"], delta="delta_seconds", censored="cens").select("uid", *_cols("neg_log_lik"))


_PROB = f"""{SCO}, pb AS (SELECT uid, label, 1-pow(10.0,-score_a) AS pr FROM sco), cb AS (SELECT CAST(least(floor(greatest(0,least(1,pr))*15),14) AS INTEGER) AS bin, count(*) AS n, avg(greatest(0,least(1,pr))) AS c, avg(label) AS a FROM pb GROUP BY 1)"""


def _probs(spark, sf):
    return scored(spark, sf).withColumn("prob", 1 - F.pow(F.lit(10.0), -F.col("score_a")))


@query("e10_calibration_curve", f"WITH {_PROB} SELECT bin, n, round(c,6) AS confidence, round(a,6)+0.0 AS accuracy, round(n/sum(n) OVER (),6) AS weight FROM cb")
def _(spark, sf):
    return E.calibration_curve(_probs(spark, sf), [], "prob", "label").select("bin", "n", *_cols("confidence", "accuracy", "weight"))


@query("e10_calibration_error", f"WITH {_PROB} SELECT round(sum(n*abs(c-a))/sum(n),6) AS ece FROM cb")
def _(spark, sf):
    return E.calibration_error(E.calibration_curve(_probs(spark, sf), [], "prob", "label"), []).select(*_cols("ece"))


_AL = ", ".join(f"{a!r}::DOUBLE" for a in sorted({min(0.9, max(1e-6, round(a, 6))) for a in E.ALPHAS}))


@query("e11_alpha_calibration", f"WITH {SCO}, al AS (SELECT unnest([{_AL}]) AS alpha), p AS (SELECT round(pow(10.0,-score_a),9) AS p FROM sco WHERE label=0) SELECT alpha, round(count(*) FILTER (p<=alpha)/count(*),6)+0.0 AS empirical, round(count(*) FILTER (p<=alpha)/count(*)-alpha,6)+0.0 AS difference FROM p CROSS JOIN al GROUP BY alpha")
def _(spark, sf):
    s = scored(spark, sf).withColumn("p", F.round(F.pow(F.lit(10.0), -F.col("score_a")), 9))
    return E.alpha_calibration(s, [], "p", "label").select("alpha", *_cols("empirical", "difference"))


_MACRO = SCO + """, mr AS (SELECT *, 'a' AS method, score_a AS score FROM sco UNION ALL SELECT *, 'b', score_b FROM sco), sc AS (SELECT method, uid, score, sum(label) AS pos, sum(1-label) AS neg FROM mr GROUP BY 1,2,3),
 cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method, uid) AS p, sum(neg) OVER (PARTITION BY method, uid) AS n FROM sc WINDOW w AS (PARTITION BY method, uid ORDER BY score DESC)),
 pu AS (SELECT method, uid, sum(tp/(tp+fp)*pos)/nullif(max(p),0) AS ap, sum(pos*((n-fp)+neg/2))/nullif(max(p)*max(n),0) AS auc FROM cv GROUP BY method, uid),
 f1 AS (SELECT method, uid, coalesce(2*count(*) FILTER (label=1 AND score>0.5)/nullif(2*count(*) FILTER (label=1 AND score>0.5)+count(*) FILTER (label=0 AND score>0.5)+count(*) FILTER (label=1 AND score<=0.5),0),0) AS f1 FROM mr GROUP BY method, uid)"""


@query("e12_macro_by_user", f"WITH {_MACRO} SELECT pu.method, round(avg(ap),6) AS average_precision, round(avg(auc),6) AS roc_auc, round(avg(f1),6) AS f1, count(*) AS users FROM pu JOIN f1 ON f1.method=pu.method AND f1.uid=pu.uid GROUP BY pu.method")
def _(spark, sf):
    m = _method_rows(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    per = E.evaluate(m, ["method", "uid"], "score", "label", "pred")
    return E.macro_by_user(per, ["method"]).select("method", *_cols("average_precision", "roc_auc", "f1"), "users")


@query("e13_method_evaluation", f"""WITH {_MET}, half AS (SELECT *, CASE WHEN epoch_s<1705363200 THEN 0 ELSE 1 END AS h FROM mr), hs AS (SELECT method, score, sum(label) pos, sum(1-label) neg FROM half WHERE h=0 GROUP BY 1,2), hc AS (SELECT *, sum(pos) OVER w tp, sum(neg) OVER w fp, sum(pos) OVER (PARTITION BY method) p FROM hs WINDOW w AS (PARTITION BY method ORDER BY score DESC)),
  th AS (SELECT method, arg_max(score, struct_pack(a := round(2*tp/(tp+fp+p),12), b := -score)) AS threshold FROM hc GROUP BY method), ts AS (SELECT method, count(*) FILTER (label=1 AND score>=threshold) tp, count(*) FILTER (label=0 AND score>=threshold) fp, count(*) FILTER (label=1 AND score<threshold) fn FROM half JOIN th USING (method) WHERE h=1 GROUP BY method)
  SELECT method, threshold, tp, fp, fn, round(2*tp/(2*tp+fp+fn),6) AS f1 FROM ts JOIN th USING (method)""")
def _(spark, sf):
    m = _method_rows(spark, sf)
    learn = E.best_f1(E.score_curve(m.where("epoch_s < 1705363200"), ["method"], "score", "label"), ["method"], "smaller")
    test = S.apply_calibration(m.where("epoch_s >= 1705363200"), learn, ["method"], "score", "pred")
    out = E.evaluate(test, ["method"], "score", "label", "pred").join(learn.select("method", "threshold"), "method")
    return out.select("method", "threshold", "tp", "fp", "fn", *_cols("f1"))


@query("e14_reference_fpr", f"""WITH {GAP}, t AS (SELECT uid, quantile_cont(delta_seconds,0.99) hi, quantile_cont(delta_seconds,0.01) lo FROM gap GROUP BY uid), f AS (SELECT CASE WHEN coalesce(delta_seconds>=hi,FALSE) OR coalesce(delta_seconds<=lo,FALSE) THEN 1 ELSE 0 END AS f FROM gap JOIN t USING (uid) WHERE label=0) SELECT count(*) AS n, CAST(sum(f) AS BIGINT) AS flagged, round(sum(f)/count(*),6) AS fpr FROM f""")
def _(spark, sf):
    from ..operators.thresholds import quantile_threshold

    g = gaps(spark, sf)
    t = quantile_threshold(g, ["uid"], "delta_seconds", 0.01).unionByName(quantile_threshold(g, [], "delta_seconds", 0.01), allowMissingColumns=True)
    return E.reference_fpr(g.where("label = 0"), t, ["uid"], "delta_seconds").withColumn("fpr", r6("fpr"))


@query("e15_temperature")
def _(spark, sf):
    return Q.calibrate_temperature(_trans(spark, sf))


@query("e15_coverage", f"""WITH {_PAIR}, c AS (SELECT rk AS k, sum(n) AS n FROM tk GROUP BY rk), v AS (SELECT k, sum(n) OVER (ORDER BY k)/sum(n) OVER () AS coverage FROM c) SELECT CAST(k AS INTEGER) AS k, round(coverage,6) AS coverage, k=(SELECT min(k) FROM v WHERE coverage>=0.99*(SELECT max(coverage) FROM v)) AS selected FROM v""")
def _(spark, sf):
    return Q.coverage_curve(_trans(spark, sf), 10).select("k", *_cols("coverage"), "selected")


_FOLD = _MET.replace("mr AS (", "mr0 AS (", 1).replace("FROM mr GROUP", "FROM mr0 GROUP") + """, fm AS (SELECT method, row_index%5 AS fold, avg(score) AS mean_score, max(score) AS max_score, CASE WHEN row_index%5<>4 THEN avg(label) END AS rate FROM mr0 GROUP BY method, row_index%5),
 lg AS (SELECT method, fold, 'mean_score' AS metric, mean_score AS value FROM fm UNION ALL SELECT method, fold, 'max_score', max_score FROM fm UNION ALL SELECT method, fold, 'rate', rate FROM fm WHERE rate IS NOT NULL)"""


def _fold_long(spark, sf):
    m = _method_rows(spark, sf).withColumn("fold", F.col("row_index") % 5)
    w = m.groupBy("method", "fold").agg(
        F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.when(F.col("fold") != 4, F.avg("label")).alias("rate")
    )
    return E.to_long(w, ["method", "fold"], ["mean_score", "max_score", "rate"])


@query("e16_fold_summary", f"WITH {_FOLD} SELECT method, metric, round(avg(value),6) AS mean, round(stddev_pop(value),6)+0.0 AS std, count(*) AS folds FROM lg GROUP BY method, metric")
def _(spark, sf):
    return E.fold_summary(_fold_long(spark, sf), ["method"]).select("method", "metric", *_cols("mean", "std"), "folds")


_BOOT = f"""{SCO}, rn AS (SELECT *, row_number() OVER (ORDER BY epoch_s, row_index)-1 AS i, count(*) OVER () AS n FROM sco), rp AS (SELECT unnest(range(4)) AS replicate), pl AS (SELECT replicate, i AS pos, n FROM rn CROSS JOIN rp),
 fr AS (SELECT *, pos=0 OR CAST('0x' || substr(md5('11:cut:' || CAST(replicate AS VARCHAR) || ':' || CAST(pos AS VARCHAR)),1,8) AS BIGINT) < 4294967296//20 AS fresh, CAST('0x' || substr(md5('11:start:' || CAST(replicate AS VARCHAR) || ':' || CAST(pos AS VARCHAR)),1,8) AS BIGINT) % n AS st FROM pl),
 bl AS (SELECT replicate, pos, n, last_value(CASE WHEN fresh THEN pos END IGNORE NULLS) OVER w AS at, last_value(CASE WHEN fresh THEN st END IGNORE NULLS) OVER w AS st FROM fr WINDOW w AS (PARTITION BY replicate ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 bs AS (SELECT replicate, rn.label, rn.score_a FROM bl JOIN rn ON rn.i=(bl.st+bl.pos-bl.at)%bl.n)"""


@query("e17_bootstrap", f"WITH {_BOOT} SELECT CAST(replicate AS INTEGER) AS replicate, count(*) AS n, round(avg(score_a),6) AS mean_score, CAST(sum(label) AS BIGINT) AS positives FROM bs GROUP BY replicate".replace(" AS at,", " AS ati,").replace("bl.pos-bl.at", "bl.pos-bl.ati"))
def _(spark, sf):
    b = E.bootstrap_rows(scored(spark, sf), ["epoch_s", "row_index"], 20, 4, 11)
    return b.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score_a")).alias("mean_score"), F.sum("label").alias("positives"))


@query("e17_bootstrap_interval")
def _(spark, sf):
    b = E.bootstrap_rows(scored(spark, sf), ["epoch_s", "row_index"], 20, 20, 11)
    c = E.ranking_metrics(E.score_curve(b, ["replicate"], "score_a", "label"), ["replicate"])
    return E.bootstrap_interval(c, [], "average_precision")


@query("e18_objective", f"""WITH {_FOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY method, metric ORDER BY value, fold) AS i, count(*) OVER (PARTITION BY method, metric) AS n FROM lg)
  SELECT method, metric, round(avg(value),6) AS mean, count(*) AS n_valid, round(avg(value)-0.5*stddev_pop(value),6) AS mean_minus_std, round(min(value),6)+0.0 AS worst_case, round(avg(value) FILTER (i>floor(n*0.25) AND i<=n-floor(n*0.25)),6) AS trimmed_mean FROM r GROUP BY method, metric""")
def _(spark, sf):
    o = E.aggregate_objective(_fold_long(spark, sf), ["method", "metric"], 0.5, 0.25)
    return o.select("method", "metric", *_cols("mean"), "n_valid", *_cols("mean_minus_std", "worst_case", "trimmed_mean"))


@query("e19_stored_metrics", f"WITH {_FOLD} SELECT fold, method, metric, round(value,6)+0.0 AS value FROM lg")
def _(spark, sf):
    long = _fold_long(spark, sf).withColumn("value", r6("value"))
    inner = long.groupBy("fold", "method").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    text = inner.groupBy("fold").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("method", "m")))).alias("metrics"))
    return E.stored_metrics(text, "metrics", ["fold"])


# splits ---------------------------------------------------------------------------


@query("g1_seeded_order", f"WITH {_ST}, b AS (SELECT session_id, floor(start_s/86400)*86400.0 AS start_s FROM st) SELECT session_id, row_number() OVER (ORDER BY start_s, md5('5:' || session_id), session_id)-1 AS rank FROM b")
def _(spark, sf):
    s = _session_rows(spark, sf).withColumn("start_s", F.floor(F.col("start_s") / 86400) * F.lit(86400.0))
    return G.ordered_sessions(s, seed=5).select("session_id", "rank")


@query("g2_rolling_origin", f"WITH {_G2} SELECT CAST(fold AS INTEGER) AS fold, session_id, role FROM ra")
def _(spark, sf):
    return _roll(spark, sf).select("fold", "session_id", "role")


_G3 = _ST + """, fd AS (SELECT unnest(range(3)) AS fold), r3 AS (SELECT fold, rk.*, CASE WHEN rank<total-3*(2*(total//15))+fold*(2*(total//15)) THEN 'train' WHEN rank<total-3*(2*(total//15))+fold*(2*(total//15))+total//15 THEN 'dev' WHEN rank<total-3*(2*(total//15))+fold*(2*(total//15))+2*(total//15) THEN 'test' END AS role FROM rk CROSS JOIN fd),
 bd AS (SELECT fold, min(start_s) FILTER (role='dev') AS d0, max(end_s) FILTER (role='test') AS t1 FROM r3 GROUP BY fold), eg AS (SELECT DISTINCT fold, grp FROM r3 WHERE role IN ('dev','test') AND CAST(grp AS INTEGER)%2=0),
 r3k AS (SELECT r3.* FROM r3 JOIN bd USING (fold) WHERE role IS NOT NULL AND (role<>'train' OR (end_s<=d0 AND NOT EXISTS (SELECT 1 FROM r3 x WHERE x.fold=r3.fold AND x.role IN ('dev','test') AND x.grp=r3.grp) AND NOT (start_s>=t1 AND start_s<t1+3600))))"""


@query("g3_rolling_purged", f"WITH {_G3} SELECT CAST(fold AS INTEGER) AS fold, session_id, role FROM r3k")
def _(spark, sf):
    s = durable(_session_rows(spark, sf))
    return G.rolling_purged(G.ordered_sessions(s), folds=3, horizon=s.count() // 15, embargo_s=3600.0).select("fold", "session_id", "role")


@query("g4_auto_embargo", f"""WITH {_ST}, gp AS (SELECT epoch_s-lag(epoch_s) OVER (PARTITION BY sid ORDER BY epoch_s,row_index) AS g FROM ses) SELECT round(greatest((SELECT max(end_s-start_s) FROM st),2*(SELECT median(g) FROM gp)),6) AS embargo_s""")
def _(spark, sf):
    s = sessions(spark, sf)
    g = session_gaps(s, "uid", "sid")
    return G.auto_embargo(session_table(s, session="sid"), g).select(*_cols("embargo_s"))


_SEED_I = "from_hex('" + bytes(b ^ 0x36 for b in b"9".ljust(64, b"\0")).hex() + "')"
_SEED_O = "from_hex('" + bytes(b ^ 0x5C for b in b"9".ljust(64, b"\0")).hex() + "')"
_HM1 = f"sha1({_SEED_O} || from_hex(sha1({_SEED_I} || encode(grp))))"
_G5 = _ST + f""", gr AS (SELECT grp, max(CASE WHEN rank>=total-greatest(1,ceil(total*0.2)) THEN 1 ELSE 0 END) AS late, min(start_s) AS s, min(end_s) AS e, CAST('0x' || substr({_HM1},1,13) AS BIGINT)/4503599627370496.0 AS r FROM rk GROUP BY grp),
 vg AS (SELECT * FROM gr WHERE late=1 AND r<0.2), nx AS (SELECT min(e) AS e FROM gr WHERE grp NOT IN (SELECT grp FROM vg)),
 px AS (SELECT grp, r, min(s) OVER (ORDER BY r, grp ROWS UNBOUNDED PRECEDING) AS cut, min(e) OVER (ORDER BY r, grp ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, row_number() OVER (ORDER BY r, grp) AS pos FROM vg),
 tk AS (SELECT max(pos) AS pos, arg_max(cut,pos) AS cut FROM px, nx WHERE least(coalesce(later,nx.e),nx.e)<=cut)"""


@query("g5_group_holdout", f"WITH {_G5} SELECT session_id, CASE WHEN grp IN (SELECT grp FROM px, tk WHERE px.pos<=tk.pos) THEN 'val' ELSE 'train' END AS role FROM rk, tk WHERE grp IN (SELECT grp FROM px, tk WHERE px.pos<=tk.pos) OR end_s<=tk.cut")
def _(spark, sf):
    r = G.ordered_sessions(_session_rows(spark, sf))
    return G.group_holdout(r, 0.2, 9).select("session_id", "role")


@query("g5_late_holdout", f"WITH {_ST}, v AS (SELECT min(start_s) AS cut FROM rk WHERE rank>=total-ceil(total*0.15)) SELECT session_id, CASE WHEN rank>=total-ceil(total*0.15) THEN 'val' ELSE 'train' END AS role FROM rk, v WHERE rank>=total-ceil(total*0.15) OR end_s<=cut")
def _(spark, sf):
    return G.late_holdout(G.ordered_sessions(_session_rows(spark, sf)), 0.15).select("session_id", "role")


@query("g6_chronological", f"WITH {_ST}, z AS (SELECT any_value(total) AS t FROM rk), p AS (SELECT t, floor(t*0.7) a, floor(t*0.1::DOUBLE) b, floor(t*0.2::DOUBLE) c, t*0.7::DOUBLE-floor(t*0.7::DOUBLE) fa, t*0.1::DOUBLE-floor(t*0.1::DOUBLE) fb, t*0.2::DOUBLE-floor(t*0.2::DOUBLE) fc FROM z),"
       " s AS (SELECT a+CASE WHEN t-a-b-c>0 AND (1+CAST(fb>fa AS INTEGER)+CAST(fc>fa AS INTEGER))<=t-a-b-c THEN 1 ELSE 0 END AS a, b+CASE WHEN t-a-b-c>0 AND (1+CAST(fa>=fb AS INTEGER)+CAST(fc>fb AS INTEGER))<=t-a-b-c THEN 1 ELSE 0 END AS b FROM p) SELECT session_id, CASE WHEN rank<s.a THEN 'train' WHEN rank<s.a+s.b THEN 'validation' ELSE 'test' END AS role FROM rk, s")
def _(spark, sf):
    return G.chronological(G.ordered_sessions(_session_rows(spark, sf))).select("session_id", "role")


@query("g7_split_violations", f"""WITH {_G2}, bd AS (SELECT fold, role, min(start_s) AS s, max(end_s) AS e FROM ra WHERE role<>'train' GROUP BY 1,2), tr AS (SELECT * FROM ra WHERE role='train'),
  l AS (SELECT bd.fold, bd.role, count(*) FILTER (tr.end_s>bd.s) AS a, count(*) FILTER (tr.start_s>=bd.e AND tr.start_s<bd.e+3600) AS b FROM tr JOIN bd ON bd.fold=tr.fold GROUP BY 1,2),
  g AS (SELECT fold, role, count(DISTINCT grp) AS c FROM ra WHERE role<>'train' AND EXISTS (SELECT 1 FROM tr WHERE tr.fold=ra.fold AND tr.grp=ra.grp) GROUP BY 1,2)
  SELECT CAST(fold AS INTEGER) AS fold, role, 'ends_after_start' AS rule, a AS violations FROM l UNION ALL SELECT CAST(fold AS INTEGER), role, 'inside_embargo', b FROM l UNION ALL SELECT CAST(fold AS INTEGER), role, 'shared_sessions', 0 FROM l UNION ALL SELECT CAST(l.fold AS INTEGER), l.role, 'shared_groups', coalesce(c,0) FROM l LEFT JOIN g ON g.fold=l.fold AND g.role=l.role""")
def _(spark, sf):
    return G.split_violations(_roll(spark, sf), 3600.0)


@query("g8_partition_summary", f"WITH {_G2} SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, CAST(sum(pos) AS BIGINT) AS positive_events, CAST(sum(events-pos) AS BIGINT) AS negative_events, CAST(sum(CASE WHEN pos>0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_sessions, count(DISTINCT grp) AS users, min(start_s) AS start_s, max(end_s) AS end_s FROM ra GROUP BY fold, role")
def _(spark, sf):
    return G.partition_summary(_roll(spark, sf))


@query("g9_cross_validation")
def _(spark, sf):
    rows = sessions(spark, sf).drop("session_id").withColumnRenamed("sid", "session_id")
    metrics, _ = cross_validate(rows, _roll(spark, sf))
    return metrics


