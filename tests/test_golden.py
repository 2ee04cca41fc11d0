"""Literal values with known results."""

import math

import pytest
from pyspark.sql import functions as F

from gapwise.functions import hashing as H
from gapwise.functions import tails as P
from gapwise.operators import features as X
from gapwise.operators import latches as L
from gapwise.operators import sequences as Q
from gapwise.operators import splits as G
from gapwise.operators import thresholds as T
from gapwise.operators.ordering import delta_labels
from gapwise.operators.sessions import RULE_VERSION, sessions_in_arrival_order

BASE = 1706745600  # 2024-02-01T00:00:00Z
SETS = {
    "bimodal-1": ([0, 60, 120, 5400, 5460, 5520], 60.0),
    "bimodal-2": ([7200, 7800, 15000], 600.0),
    "noisy-1": ([0, 40, 190, 205, 600, 7200, 7530, 7550, 9000], 1133.5),
    "noisy-2": ([10800, 10820, 19800], 20.0),
    "unimodal-1": ([0, 600, 1200, 1800], 600.0),
}


@pytest.fixture(scope="module")
def visits(spark):
    rows, i = [], 0
    for uid, (times, _) in SETS.items():
        for t in times:
            rows.append((i, uid, float(BASE + t), ""))
            i += 1
    return spark.createDataFrame(rows, "row_index bigint, uid string, epoch_s double, session_id string")


def test_session_ids(visits):
    import base64

    key = H.derive_key(base64.b64decode("c2VlZF9kZWZhdWx0X2p3dF9obWFjX2tleV8xMjM0NTY="))
    out = sessions_in_arrival_order(visits, 1800.0, key=key)
    first = out.where("uid = 'bimodal-1'").orderBy("row_index").collect()
    assert [r["split_reason"] for r in first] == ["initial", "continuous", "continuous", "idle_timeout", "continuous", "continuous"]
    assert [r["session_index"] for r in first] == [0, 1, 2, 0, 1, 2]


def test_session_id_value(spark):
    import base64

    secret = base64.b64decode("c2VlZF9kZWZhdWx0X2p3dF9obWFjX2tleV8xMjM0NTY=")
    df = spark.createDataFrame([("bimodal-1", float(BASE))], "uid string, t double")
    got = df.select(H.session_key(H.derive_key(secret), F.col("uid"), F.col("t"), RULE_VERSION)).first()[0]
    assert got == "9a785336d7d9ed79378ddf3c27b3ffa49db977f12b975cd362acf6952a0f2a2b"


def test_session_thresholds(visits):
    s = sessions_in_arrival_order(visits, 1800.0)
    t = {r["uid"]: r for r in T.combined_session_threshold(s, ["uid"], min_samples=1).collect()}
    for uid, (_, want) in SETS.items():
        assert t[uid]["delta_t"] == pytest.approx(want, abs=1e-6), uid
    assert t["noisy-1"]["fd_bins"] == 32
    assert t["noisy-1"]["tau_otsu"] == pytest.approx(3.70801521485805)
    assert t["noisy-1"]["tau_knee"] == pytest.approx(6.058050201102199)
    assert t["bimodal-1"]["fd_bins"] == 1 and t["bimodal-1"]["tau_otsu"] == pytest.approx(math.log(60))


FEATURES = [
    # uid, epoch, gap, clipped, robust z, seasonal z, burst, m25, m50, m75, label
    ("user-extreme", 1720000000.0, None, None, None, None, None, None, None, None, "initial"),
    ("user-extreme", 1720000000.25, 0.25, 0.25, -5, -0.674490759, None, None, None, None, "measured"),
    ("user-extreme", 1720000300.0, 299.75, 299.75, 0, 0.674490759, -5, 0.25, 0.25, 0.25, "measured"),
    ("user-extreme", 1720001800.0, 1500, 300, 0.674490759, 0, -1.610270258, 75.125, 150, 224.875, "measured"),
    ("user-seasonal", 1720003600.0, None, None, None, None, None, None, None, None, "initial"),
    ("user-seasonal", 1720003660.0, 60, 60, 0, 0, None, None, None, None, "measured"),
    ("user-seasonal", 1720007260.0, 3600, 300, 2.703821317, 0.674490759, -4.094336368, 60, 60, 60, "measured"),
    ("user-seasonal", 1720007320.0, 60, 60, 0, -0.674490759, 4.094336368, 120, 180, 240, "measured"),
    ("user-missing", 1720004400.0, None, None, None, None, None, None, None, None, "initial"),
    ("user-missing", 1720004400.01, 0.01, 0.01, -0.67584267, -5, None, None, None, None, "unknown"),
    ("user-small", 1720009400.0, None, None, None, None, None, None, None, None, "initial"),
    ("user-small", 1720009430.0, 30, 30, -0.337977665, 0, None, None, None, None, "measured"),
]


def test_features(spark):
    rows = [(i, r[0], r[1], "s") for i, r in enumerate(FEATURES)]
    df = spark.createDataFrame(rows, "row_index bigint, uid string, epoch_s double, session_id string")
    f = X.gap_features(delta_labels(df, ["uid"], epsilon=0.0005, epsilon_t=0.05), epsilon=0.0005, clip_seconds=300)
    out = X.robust_scores(f, epsilon=0.0005, min_samples=2)
    cols = ["delta_seconds", "delta_clipped_seconds", "delta_robust_z", "delta_z_deseas_clipped", "delta_log_burst",
            "delta_m25", "delta_m50", "delta_m75"]
    for r, want in zip(out.orderBy("row_index").collect(), FEATURES, strict=True):
        assert r["time_label"] == want[10]
        for c, w in zip(cols, want[2:10], strict=True):
            if w is None:
                assert r[c] is None, (r, c)
            else:
                assert r[c] == pytest.approx(w, abs=2e-5), (want[0], want[1], c)


def test_clearing_latch_values(spark):
    df = spark.createDataFrame([(i, "u", d / 4.5) for i, d in enumerate([4.0, 10.0, 4.7, 4.0])], "i bigint, k string, s double")
    out = L.clearing_latch(df, ["k"], ["i"], "s", 1, 1, 1.1).orderBy("i").collect()
    assert [r["alarm"] for r in out] == [False, True, True, False]


def test_tail_limits(spark):
    one = spark.range(1)
    for xi in (1e-14, -1e-14):
        a = one.select(P.tail_threshold(math.log(5), xi, 0.7, 0.01, 0.0025), P.tail_survival(1.3, xi, 0.7)).first()
        assert a[0] == pytest.approx(math.log(5) + 0.7 * math.log(4))
        assert a[1] == pytest.approx(math.exp(-1.3 / 0.7))


def test_event_time_scores(spark):
    want = [(1, 0.7637101045, 5.082616232, 0.278925116506, 0.5545123768), (2, 0.9868072851, 10.8534055188, 0.028261886669, 1.5487988495),
            (3, 0.9999588746, 22.3949958094, 0.000167208827, 3.776740799)]
    df = spark.createDataFrame([(float(w[0]),) for w in want], "d double")
    df = df.withColumn("p_time", 1 - P.hazard_survival(0.0, 0.6931481957, F.col("d")))
    df = df.withColumns(Q.combine_event_time(F.lit(0.3333333433), F.col("p_time"), F.lit(False)))
    for r, w in zip(df.orderBy("d").collect(), want, strict=True):
        assert r["p_time"] == pytest.approx(w[1], abs=1e-6)
        assert r["fisher_statistic"] == pytest.approx(w[2], abs=1e-4)
        assert r["combined_p"] == pytest.approx(w[3], abs=1e-7)
        assert r["neglog10_p"] == pytest.approx(w[4], abs=1e-5)


@pytest.mark.parametrize("n,want", [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 0, 1)), (3, (2, 1, 0)), (4, (3, 1, 0)), (5, (3, 1, 1)), (10, (7, 1, 2)), (100, (70, 10, 20))])
def test_partition_sizes(n, want):
    assert G.partition_sizes(n) == want


def test_group_rank(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(G.group_rank(F.lit("alice"), 17)).first()[0]
    digest = hmac.new(b"17", b"alice", hashlib.sha1).digest()
    assert got == pytest.approx(int.from_bytes(digest, "big") / 2**160, abs=1e-12)


def test_weighted_fusion(spark):
    from gapwise.functions.chisq import weighted_fisher_neg_log10

    df = spark.createDataFrame([(0.5, 1.5), (2.0, 0.0), (8.0, 3.0)], "a double, b double")
    # equal weights in the general form match the closed form
    r = df.select(weighted_fisher_neg_log10(F.col("a"), F.col("b"), 1.0, 1.0).alias("w"), P.fisher_neg_log10(F.col("a"), F.col("b")).alias("c")).collect()
    for x in r:
        assert x["w"] == pytest.approx(x["c"], abs=1e-9)
