"""Chunked evaluation equals the plain one, wherever the cuts fall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise import scale as S
from gapwise.operators import latches as L
from gapwise.operators import mixtures as M
from gapwise.operators import online as N
from gapwise.operators import tailfit as G
from gapwise.plans.views import events


def rows_of(df):
    return sorted(map(str, df.drop(*[c for c in df.columns if c.startswith("_chunk")]).collect()))


@pytest.fixture(scope="module")
def log(spark, sf):
    e = events(spark, sf).select("uid", "row_index", "epoch_s", "event", "value")
    hot = e.withColumn("uid", F.when(F.col("row_index") % 3 == 0, "hot").otherwise(F.col("uid")))
    return hot.withColumn("nv", F.when(F.col("row_index") % 5 == 0, F.col("value")))


def steps():
    return {
        "prev": S.previous("nv"),
        "sum_": S.running_sum(F.lit(1)),
        "before": S.running_sum(F.lit(1), inclusive=False),
        "high": S.running_max("nv", inclusive=False),
        "seen": S.last_seen("nv"),
        "upto": S.last_seen("nv", inclusive=True),
        "first": S.first_of("nv"),
        "all_": S.total(F.lit(1)),
        "tail": S.trailing("nv", 4),
        "tail_now": S.trailing("value", 3, inclusive=True),
    }


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("keys", [["uid"], ["event", "uid"], []])
def test_scan(spark, log, keys, reverse):
    plain = rows_of(S.scan(log, keys, ["epoch_s", "row_index"], steps(), reverse))
    spark.conf.set("gapwise.hot.rows", "25")
    try:
        out = S.scan(log, keys, ["epoch_s", "row_index"], steps(), reverse)
        assert out.select(S.chunk_column(keys[:1], "epoch_s")).distinct().count() > 5
        assert rows_of(out) == plain
    finally:
        spark.conf.unset("gapwise.hot.rows")


def test_scans_by_different_keys_on_one_order(cut, log):
    """Chunks made for one key are not taken for those of another."""
    pdf = log.select("uid", "event", "epoch_s", "row_index").toPandas().sort_values(["epoch_s", "row_index"])
    order, frame = ["epoch_s", "row_index"], log
    for name, keys in {"a": ["uid"], "b": ["event"], "c": [], "d": ["uid", "event"]}.items():
        frame = S.scan(frame, keys, order, {name: S.running_sum(F.lit(1))})
        pdf[name] = (pdf.groupby(keys) if keys else pdf).cumcount() + 1 if keys else range(1, len(pdf) + 1)
    got = frame.select("row_index", "a", "b", "c", "d").toPandas().sort_values("row_index").to_numpy()
    assert (got == pdf.sort_values("row_index")[["row_index", "a", "b", "c", "d"]].to_numpy()).all()


def test_chunks_stay_small_however_large_the_key(spark):
    spark.conf.set("gapwise.hot.rows", "20")
    try:
        rows = spark.range(40_000).select(F.lit("k").alias("k"), F.xxhash64("id").alias("t"))
        sizes = S.split(rows, ["k"], "t").groupBy(S.chunk_column(["k"], "t")).count().select("count").toPandas()["count"]
    finally:
        spark.conf.unset("gapwise.hot.rows")
    assert len(sizes) > 1000 and sizes.max() < 400


def test_no_task_holds_the_hot_key(cut, log):
    out = S.split(log, ["uid"], "epoch_s")
    per = out.groupBy("uid", S.chunk_column(["uid"], "epoch_s")).count()
    hot = out.where("uid = 'hot'").count()
    assert hot > 300 and per.agg(F.max("count")).first()[0] < hot / 4


def test_keys_without_hot_rows_are_left_alone(cut, log):
    cut.conf.set("gapwise.hot.rows", "100000")
    out = S.split(log, ["uid"], "epoch_s")
    assert not S.is_cut(out, ["uid"], "epoch_s")


@pytest.mark.parametrize("rule", ["r7", "simple"])
@pytest.mark.parametrize("keys", [["uid"], []])
def test_quantiles(spark, log, keys, rule):
    levels = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0 - 1e-9}
    pdf = log.toPandas()
    groups = pdf.groupby("uid")["value"] if keys else [("", pdf["value"])]

    def simple(x, p):
        x = np.sort(x)
        n = len(x)
        if p == 0:
            return x[0]
        k = n * p
        if k % 1:
            return x[int(np.ceil(k)) - 1]
        return x[int(k)] if n % 2 else (x[int(k) - 1] + x[int(k)]) / 2

    want = {k: [np.quantile(x, p) if rule == "r7" else simple(x, p) for p in levels.values()] for k, x in groups}
    lv = dict(levels) if rule == "r7" else {k: p for k, p in levels.items() if p > 0}
    got = S.quantiles(log, keys, "value", lv, rule).collect()
    assert len(got) == len(want)
    for r in got:
        w = dict(zip(levels, want[r["uid"] if keys else ""], strict=True))
        for name in lv:
            assert r[name] == pytest.approx(w[name], abs=1e-9)


def test_quantiles_cut(cut, log):
    got = S.quantiles(log, [], "value", {"m": 0.5}).first()["m"]
    assert got == pytest.approx(float(np.median(log.toPandas()["value"])))


def latch_by_hand(s, k, n, h):
    votes, on, out = [], False, []
    for x in s:
        votes = [*votes, x > 1][-n:]
        if on:
            if x <= 1 / h:
                on, votes = False, []
        elif sum(votes) >= k:
            on = True
        out.append(on)
    return out


def test_clearing_latch(cut, log):
    rows = log.select("uid", "epoch_s", "row_index", (F.col("value") / 40).alias("s"))
    want = []
    for _, g in rows.toPandas().sort_values(["epoch_s", "row_index"]).groupby("uid"):
        want += list(zip(g["row_index"], latch_by_hand(g["s"], 2, 4, 1.3), strict=True))
    got = L.clearing_latch(rows, ["uid"], ["epoch_s", "row_index"], "s", 2, 4, 1.3)
    assert sorted((r["row_index"], r["alarm"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("r", [0, 3, 40, 700])
def test_decluster(cut, log, r):
    rows = log.where("value > 20").select("uid", "row_index")
    want = []
    for u, g in rows.toPandas().sort_values("row_index").groupby("uid"):
        last = -10**9
        for i in g["row_index"]:
            if i - last > r:
                want.append((u, i))
                last = i
    got = G.decluster(rows, ["uid"], "row_index", r)
    assert sorted((x["uid"], x["row_index"]) for x in got.collect()) == sorted(want)


def test_running_stats(cut, log):
    start = log.select("uid").distinct().withColumns({"x_med": F.lit(30.0), "x_smad": F.lit(5.0)})
    rows = log.select("uid", "epoch_s", "row_index", "value")
    got = {r["row_index"]: (r["x_med"], r["x_smad"]) for r in N.running_stats(rows, start, ["uid"], ["epoch_s", "row_index"], "value").collect()}
    for _, g in rows.toPandas().sort_values(["epoch_s", "row_index"]).groupby("uid"):
        med, smad = 30.0, 5.0
        for i, x in zip(g["row_index"], g["value"], strict=True):
            med, smad = N.update(x, med, smad, 0.05, (3.0, 3.0), 0.1)
            assert got[i] == pytest.approx((med, smad))


def test_odd_mixtures_by_both_routes(spark, cut):
    """Few rows, one value, two far values of very unequal weight, values far beyond one component: the same value or NULL."""
    groups = {
        "few": [(0.0, 2), (1.0, 3)],
        "one": [(1.5, 400)],
        "two": [(0.0, 100_000), (900.0, 1)],
        "far": [(0.0, 30), (1e-9, 30), (1e6, 30), (-1e6, 1)],
        "apart": [(i / 50, 3) for i in range(50)] + [(9 + i / 40, 4) for i in range(40)],
    }
    wv = S.durable(spark.createDataFrame([(k, float(x), n) for k, v in groups.items() for x, n in v], "event string, l double, n long"))
    by = [{r["event"]: r["bic_difference"] for r in df.collect()} for df in (M.bimodality(wv, ["event"]), M.bimodality(wv, ["event"], group_limit=0))]
    assert set(by[0]) == set(by[1]) == set(groups)
    assert by[0]["few"] is None and by[0]["one"] is None and by[0]["apart"] > 0
    for k in groups:
        assert by[0][k] == (by[1][k] if by[1][k] is None else pytest.approx(by[1][k], rel=1e-6)), k


def test_large_mixture_equals_small(cut, log):
    wv = S.weighted(log.where("value > 0").select("event", F.col("value").alias("x")), ["event"], "x").withColumn("l", F.ln("x"))
    wv = S.durable(wv)
    small = {r["event"]: r["bic_difference"] for r in M.bimodality(wv, ["event"]).collect()}
    large = {r["event"]: r["bic_difference"] for r in M._test_large(wv, ["event"]).collect()}
    assert set(small) == set(large)
    for k, v in small.items():
        assert (v is None) == (large[k] is None)
        if v is not None:
            assert large[k] == pytest.approx(v, rel=1e-4, abs=1e-3)


def test_tail_fit_equals_sample_and_beats_neighbours(spark, log):
    exc = S.durable(S.weighted(log.where("value > 40").select("event", (F.col("value") - 40).alias("y")), ["event"], "y"))
    pdf = exc.toPandas()
    for r in G.fit_tails(exc, ["event"]).collect():
        y, n = (pdf[pdf["event"] == r["event"]][c].to_numpy(float) for c in ("y", "n"))
        want = G.fit_excesses(y, n, 1e-6)
        assert (r["xi"], r["beta"]) == pytest.approx(want[:2], rel=1e-6, abs=1e-8) and r["estimator"] == want[2] == "mle"

        def cost(xi, beta, y=y, n=n):
            inside = 1 + xi * y / beta
            return math.inf if (inside <= 0).any() else n.sum() * math.log(beta) + (1 + 1 / xi) * (n * np.log(inside)).sum()

        for dx, db in ((1e-3, 1), (-1e-3, 1), (0, 1.002), (0, 0.998), (1e-3, 0.998), (-1e-3, 1.002)):
            if G.XI_RANGE[0] <= r["xi"] + dx <= G.XI_RANGE[1]:
                assert cost(r["xi"], r["beta"]) <= cost(r["xi"] + dx, r["beta"] * db) + 1e-9


@pytest.mark.parametrize("bounds", [G.XI_RANGE, (-0.49, 10.0)])
def test_tail_fit_of_odd_groups(spark, bounds):
    rng = np.random.default_rng(5)
    groups = {"zero": [0.0] * 9, "one": [3.0], "equal": [2.0] * 7, "uniform": rng.random(400), "heavy": rng.random(900) ** -4.0, None: rng.exponential(2, 500)}
    rows = [(k, float(v), 1) for k, vs in groups.items() for v in vs]
    exc = S.weighted(spark.createDataFrame(rows, "k string, y double, one int"), ["k"], "y")
    got = {r["k"]: r for r in G.fit_tails(exc, ["k"], 1e-8, bounds).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        want = G.fit_excesses(np.array(vs, float), np.ones(len(vs)), 1e-8, bounds)
        assert got[k]["estimator"] == want[2] == ("quantile" if k == "zero" else "mle")
        assert (got[k]["xi"], got[k]["beta"]) == pytest.approx(want[:2], rel=1e-5, abs=1e-7)
        assert bounds[0] <= got[k]["xi"] <= bounds[1]


def test_tail_fit_recovers_parameters():
    rng = np.random.default_rng(3)
    u = rng.random(20000)
    xi, beta = 0.2, 3.0
    y = beta / xi * (u**-xi - 1)
    got = G.fit_excesses(y, np.ones(len(y)), 1e-6)
    assert got[0] == pytest.approx(xi, abs=0.03) and got[1] == pytest.approx(beta, rel=0.05) and got[2] == "mle"


def test_calibrate_equals_sample(spark, log):
    rows = log.select(F.ln(F.col("value") + 1).alias("x"), "row_index")
    got = G.calibrate(rows, [], "x", min_tail=20).first()
    pdf = rows.toPandas()
    want = G.calibrate_sample(pdf["x"].to_numpy(), pdf["row_index"].to_numpy(), min_tail=20)
    for c in ("u", "xi", "beta", "theta", "p_ref", "q_star"):
        assert got[c] == pytest.approx(want[c], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("name", ["w5_sessions_arrival", "w9_rolling_quantiles", "w18_protocol_rules", "l2_ratio_latch", "e3_e4_ranking_metrics", "j8_interval_antijoin", "w19_segments", "o2_session_order"])
def test_queries_cut(cut, sf, name):
    from compare import differences, duck

    import __spark_entry__ as entry

    bad, _ = differences(entry.queries()[name](cut, sf), duck(sf), entry.oracle_sql()[name])
    assert not bad, bad


def test_row_order_does_not_matter(spark, log):
    from gapwise.operators.ordering import delta_labels

    want = rows_of(delta_labels(log, ["uid"]))
    for n in (1, 4, 17):
        assert rows_of(delta_labels(log.repartition(n, F.rand(n)), ["uid"])) == want
