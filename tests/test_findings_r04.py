"""Large groups of the mixture test under any key names; many small tail models need one shuffle."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise import scale as S
from gapwise.operators import mixtures as M
from gapwise.operators import scoring as C
from gapwise.operators import tailfit as G
from gapwise.operators import thresholds as H


@pytest.fixture(scope="module")
def two_modes(spark):
    """Gaps of 12 users around one second and around an hour, 40 different ones each, in two groups and one blank one."""
    r = spark.range(480).withColumns({"uid": (F.col("id") % 12).cast("string"), "i": F.floor(F.col("id") / 12)})
    gap = F.exp(F.when(F.col("i") % 2 == 0, 0.0).otherwise(8.0) + (F.col("id") * 37 % 101) / 101)
    return r.select("uid", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(" ")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
                    F.col("id").alias("row_index"), gap.alias("delta_seconds"))


def test_backoff_with_groups_above_the_limit(two_modes, monkeypatch):
    def found():
        t = H.backoff_thresholds(two_modes, group=F.col("kind"), label="kind", min_events=60)
        return {r["uid"]: (r["backoff_level"], r["n_rows"], r["delta_t"], r["bimodality_test"]) for r in t.collect()}

    whole = found()
    monkeypatch.setattr(M, "bimodality", partial(M.bimodality, group_limit=60))
    again = found()
    assert len(whole) == 12 and {v[0] for v in whole.values()} == {"group:kind=a", "group:kind=b", "group:kind=unknown"}
    for uid, (level, n, delta, test) in whole.items():
        assert test > 0 and again[uid] == (level, n, pytest.approx(delta), pytest.approx(test))


@pytest.mark.parametrize("limit", [0, 40, 1000])
def test_mixture_keys_may_have_any_name(two_modes, limit):
    wv = two_modes.select(F.col("kind").alias("_g"), F.lit(None).cast("string").alias("size"), F.when(F.col("uid") < "5", F.col("uid")).alias("total"),
                          F.ln("delta_seconds").alias("l"), F.lit(1).alias("n"))
    got = M.bimodality(wv, ["_g", "size", "total"], group_limit=limit)
    rows = {tuple(r)[:3]: r["bic_difference"] for r in got.collect()}
    assert got.columns == ["_g", "size", "total", "bic_difference"]
    assert set(rows) == {tuple(r) for r in wv.select("_g", "size", "total").distinct().collect()}
    assert all(v > 0 for v in rows.values())


def _excesses():
    """Groups of 1 to 40 excesses, one without a key, one of zeros, one above the limit of the ``cut`` fixture, one endless."""
    draw = np.random.default_rng(5)
    rows = [(g or None, g % 3 > 0, float(y), int(n)) for g in range(41) for y, n in zip(draw.pareto(1 + g % 4, max(g, 1)), draw.integers(1, 4, max(g, 1)), strict=True)]
    return [*rows, (100, True, 0.0, 5), *[(101, True, float(i) ** 2, 1) for i in range(200)], (102, True, 1.0, 2), (102, True, float("inf"), 1)]


@pytest.fixture(scope="module")
def excesses(spark):
    return S.durable(spark.createDataFrame(_excesses(), "a long, b boolean, y double, n long"))


def test_small_tails_are_fitted_in_one_shuffle(excesses):
    plan = G.fit_tails(excesses.where("a < 100"), ["a", "b"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "HashAggregate" not in plan


def test_tails_are_the_same_by_both_routes(spark, excesses):
    def fitted():
        return {(r["a"], r["b"]): (r["estimator"], r["xi"], r["beta"]) for r in G.fit_tails(excesses, ["a", "b"]).collect()}

    small = fitted()
    spark.conf.set("gapwise.hot.rows", "0")
    try:
        large = fitted()
    finally:
        spark.conf.unset("gapwise.hot.rows")
    assert len(small) == len(large) == 44 and small.pop((102, True)) == large.pop((102, True))
    assert small[100, True] == ("quantile", 0.0, 1e-6)
    for key, (kind, xi, beta) in large.items():
        assert small[key] == (kind, pytest.approx(xi, abs=1e-7), pytest.approx(beta, rel=1e-7))


@pytest.mark.parametrize("limit", ["25", "500000"])
def test_calibration_of_many_keys(spark, limit):
    """Few rows, ties and a missing key: levels are lowered as for one sample."""
    draw = np.random.default_rng(9)
    groups = {k: np.round(draw.exponential(3, size) ** 2, digits) for k, (size, digits) in {"a": (70, 0), "b": (9, 3), None: (33, 1), "c": (400, 2)}.items()}
    rows = [(k, float(v), i) for k, x in groups.items() for i, v in enumerate(x)]
    spark.conf.set("gapwise.hot.rows", limit)
    try:
        got = {r["k"]: r for r in G.calibrate(spark.createDataFrame(rows, "k string, x double, i long"), ["k"], "x", index="i", min_tail=12, r=2).collect()}
    finally:
        spark.conf.unset("gapwise.hot.rows")
    assert set(got) == set(groups)
    for k, x in groups.items():
        want = G.calibrate_sample(x, np.arange(len(x)), min_tail=12, r=2)
        for name in ("u", "xi", "beta", "theta", "p_ref", "q_star"):
            assert got[k][name] == pytest.approx(want[name], rel=1e-6, abs=1e-7)
        assert got[k]["n"] == len(x) and got[k]["estimator"] == want["estimator"]


def test_levels_are_computed_on_the_entries(spark, monkeypatch):
    """The scored row takes its level from the entry, the share is computed once."""
    seen = []
    monkeypatch.setattr(C, "lookup", lambda rows, table, columns, *rest, find=C.lookup: seen.append(list(columns)) or find(rows, table, columns, *rest))
    cdf = "array(struct(0.1D AS p, 1.0D AS value), struct(0.9D AS p, 5.0D AS value))"
    q = spark.sql(f"SELECT 'u' AS uid, 'R' AS op_category, 5.0D AS tau_hi, 1.0D AS tau_lo, {cdf} AS cdf")
    t = spark.sql("SELECT 'u' AS uid, 'R' AS op_category, 1.0D AS u, 0.1D AS xi, 0.5D AS beta, 0.1D AS p_ref, 1.0D AS theta, 0.001D AS q_star, 'mle' AS estimator")
    rows = spark.createDataFrame([("u", "R", i, float(2**i), float(i) * 0.6931471805599453) for i in range(8)], "uid string, op_category string, row_index long, delta_seconds double, log_dt double")
    out = C.score_rows(rows, q, t)
    assert "tau_t" in seen[1]
    got = out.orderBy("row_index").collect()
    level = 1 + 0.5 / 0.1 * (100**0.1 - 1)
    assert all(r["tau_t"] == pytest.approx(np.exp(level)) and r["p_lower"] + r["p_upper_quantile"] == 1 for r in got)
    assert [r["p_lower"] for r in got] == pytest.approx([0.1, 0.3, 0.7, 1.0, 1.0, 1.0, 1.0, 1.0])
    assert [r["alarm"] for r in got] == [False] * 8 and got[0]["s_evt"] == pytest.approx(1 / np.exp(level))
    assert out.columns[5:15] == ["tau_hi", "tau_lo", "u", "xi", "beta", "p_ref", "theta", "q_star", "estimator", "entry"]
