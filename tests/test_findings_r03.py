"""Work that must not grow with the number of keys or pass through one place."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gapwise import scale as S
from gapwise.operators import evaluation as E
from gapwise.operators import latches as L
from gapwise.operators import mixtures as M
from gapwise.operators import tailfit as G
from gapwise.streaming.runner import in_turns


@pytest.fixture(scope="module")
def many(spark):
    """One first key with 100 small groups below it."""
    return S.durable(spark.range(1500).select(F.lit("all").alias("a"), (F.col("id") % 100).alias("b"), F.col("id").alias("t")))


def test_only_large_groups_are_cut(cut, many):
    out = S.scan(many, ["a", "b"], ["t"], {"no": S.running_sum(F.lit(1)), "of": S.total(F.lit(1))})
    assert out.select(S.chunk_column(["a"], "t")).distinct().collect() == [(-1,)]
    assert out.where("no <> floor(t / 100) + 1 OR of <> 15").isEmpty()


@pytest.mark.parametrize("run", [lambda d: G.decluster(d, ["a", "b"], "t", 150), lambda d: L.clearing_latch(d.withColumn("s", F.lit(2.0)), ["a", "b"], ["t"], "s")])
def test_many_small_groups_need_no_call_each(spark, many, run):
    plan = run(many)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_decluster_with_missing_keys(spark):
    rows = [(None, 1), (None, 2), (None, 9), ("x", 2), ("x", 30), ("y", 3)]
    got = G.decluster(spark.createDataFrame(rows, "k string, i long"), ["k"], "i", 5).collect()
    assert sorted(map(str, got)) == sorted(f"Row(k={k!r}, i={i})" for k, i in [(None, 1), (None, 9), ("x", 2), ("x", 30), ("y", 3)])


def test_first_rows_rank_the_index_only(spark, many, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "scan", lambda df, *rest: seen.append(df.columns) or S.scan(df, *rest))
    got = G.calibration_rows(many, first=37, index="t")
    assert seen[0] == ["t", "_n"] and sorted(r["t"] for r in got.collect()) == list(range(37))


def test_bootstrap_orders_blocks_only(spark, many, monkeypatch):
    seen, n = [], 1500
    monkeypatch.setattr(E, "scan", lambda df, keys, *rest, **more: seen.append((keys, df.count())) or S.scan(df, keys, *rest, **more))
    got = {(r["replicate"], r["pos"]): r["t"] for r in E.bootstrap_rows(many, ["t"], 20, 3, 11).collect()}
    assert [c for k, c in seen if k == ["replicate"]][0] < 3 * n / 10

    def draw(what, *parts):
        return int(hashlib.md5(":".join(map(str, ("11", what, *parts))).encode()).hexdigest()[:8], 16)

    for rep in range(3):
        for pos in range(n):
            if pos == 0 or draw("cut", rep, pos) < 2**32 // 20:
                at, start = pos, draw("start", rep, pos) % n
            assert got.pop((rep, pos)) == (start + pos - at) % n
    assert not got


def test_turns_follow_the_order(cut, many):
    stream = in_turns(many.repartition(5), "t")
    base = stream._jdf.queryExecution().analyzed().toString()
    assert "FileSource" in base or "StreamingRelation" in base
    root = os.path.join(S.shared_folder(cut), "gapwise")
    newest = max(glob.glob(f"{root}/turns-*"), key=os.path.getmtime)
    files = sorted(glob.glob(f"{newest}/*/*.parquet"), key=os.path.getmtime)
    ends = [cut.read.parquet(f).agg(F.min("t"), F.max("t"), F.count("t")).first() for f in files]
    assert sum(e[2] for e in ends) == 1500 and max(e[2] for e in ends) < 300 and len(files) > 20
    assert all(a[1] < b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))


BIG = 2**60


@pytest.fixture(scope="module")
def mixed(spark):
    """Weighted logarithms of 60 small groups of one, two or equal modes, one of them without a key."""
    rows = [(BIG + g if g else None, "x", g % 3 * (i % 2) * 4.0 + (i * 37 % 23) / 23, 1 + i % 2) for g in range(60) for i in range(g)]
    return S.durable(spark.createDataFrame(rows, "a long, b string, l double, n long"))


def test_mixtures_need_no_call_each(mixed):
    plan = M.bimodality(mixed, ["a", "b"])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("batch", ["1", "7"])
def test_mixture_groups_go_on_over_batches(spark, mixed, batch):
    def values():
        return {r["a"]: r["bic_difference"] for r in M.bimodality(mixed, ["a", "b"]).collect()}

    whole = values()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert values() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(whole) == {BIG + g for g in range(1, 60)} and None in whole.values()
    assert all(v is None or v > 0 for k, v in whole.items() if (k - BIG) % 3 and k - BIG > 20)


def test_mixture_without_keys_above_the_limit(mixed):
    (small,), (large,) = (M.bimodality(mixed, [], group_limit=n).collect() for n in (100_000, 5))
    assert small["bic_difference"] == pytest.approx(large["bic_difference"])


def test_mixture_of_large_groups_runs_one_job_a_round(spark, mixed):
    rounds, seen = [], M._Fits.move

    def move(self, *args):
        rounds.append(len(self.live))
        return seen(self, *args)

    M._Fits.move = move
    spark.sparkContext.setJobGroup("rounds", "rounds of the mixture test")
    try:
        M.bimodality(mixed, ["b"], group_limit=0).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        M._Fits.move = seen
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rounds and jobs < 4 * len(rounds) + 60
