"""Results outside the sample tables: nested values, separators, large numbers, other split layouts."""

import json

import pytest

from pyspark.sql import functions as F

from gapwise.operators import contract, ordering, statistics
from gapwise.sources import logs, provenance

LOG = "timestamp_utc,uid,session_id,method,path,referer,user_agent,ip,cookie,op_category"


def test_rows_keep_their_number_when_splits_change(spark, tmp_path):
    for part in range(3):
        lines = "".join(f"{part}{i},u,s,GET,/p/{'x' * (i % 40)},,a,1.1.1.1,c,READ\n" for i in range(5000))
        (tmp_path / f"{part}.csv").write_text(f"{LOG}\n{lines}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = logs.read_log_csv(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
        got = rows.select("row_index", "timestamp_utc").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["row_index"], r["timestamp_utc"]) for r in got) == [(p * 5000 + i, f"{p}{i}") for p in range(3) for i in range(5000)]


def test_digests_tell_separators_and_nulls_apart(spark):
    rows = [("x|y", "z"), ("x", "y|z"), ("", None), (None, ""), (None, None), ("1:a", "b"), ("1", "a1:b")]
    parts = set()
    for r in rows:
        parts.add(tuple(provenance.dataset_fingerprint(spark.createDataFrame([r], "a string, b string")).first()))
    assert len(parts) == len(rows)


def test_digest_sums_do_not_overflow(spark):
    big = spark.range(3).select(F.lit("f" * 64).alias("h"))
    many = big.agg((F.sum(F.lit(2**62).cast("decimal(38,0)")) % F.lit(str(2**63)).cast("decimal(38,0)")).cast("long").alias("s")).first()
    assert many["s"] == 2**62
    assert big.agg(provenance._sum_of("h", 1).alias("s")).first()["s"] == 3 * (2**32 - 1)


def test_merged_moments_of_epochs(spark):
    values = [1.7e9 + 0.01 * i for i in range(100)]
    rows = spark.createDataFrame([(i % 4, v) for i, v in enumerate(values)], "part int, v double")
    parts = statistics.moments(rows, ["part"], "v")
    (r,) = statistics.merge_moments(parts.withColumn("k", F.lit(1)), ["k"]).collect()
    mean = sum(values) / 100
    assert abs(r["m2"] - sum((v - mean) ** 2 for v in values)) < 1e-3
    assert r["n"] == 100 and r["lowest"] == values[0]


def test_redaction_at_every_level(spark):
    cases = {
        '{"a":{"token":"abc"},"b":1}': {"b": 1},
        '{"a":[{"jwt":"x"},{"c":[1,"Bearer aa.bb.cc"]}],"d":null,"e":2.5,"f":true}': {"a": [{"c": [1]}], "d": None, "e": 2.5, "f": True},
        '["eyJabcdefghijk.abcdefghijk"]': {},
        "[1,2]": {"value": [1, 2]},
        "7": {"value": 7},
        "null": {},
        '{"x":{"y":{"z":{"w":{"v":{"u":{"cookie":1,"k":2}}}}},"q":1}}': {"x": {"q": 1}},
        '{"x":{"y":[[],{}],"z":[{"token":1},{"k":[null,"a"]}]}}': {"x": {"z": [{"k": [None, "a"]}]}},
        "no json": None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r["t"]: r["r"] for r in rows.select("t", contract.redact_metadata(F.col("t")).alias("r")).collect()}
    assert {k: None if v is None else json.loads(v) for k, v in got.items()} == cases


def test_token_column_is_legal_but_found(spark):
    rows = spark.createDataFrame([("1", "t")], "uid string, token string")
    assert contract.refuse_forbidden(rows) is rows
    assert ("token", "forbidden") in {tuple(r) for r in contract.column_findings(rows).collect()}
    try:
        contract.refuse_forbidden(rows.withColumnRenamed("token", "Cookie"))
    except ValueError:
        return
    raise AssertionError("Cookie was accepted")


def test_first_to_arrive_stays(spark):
    rows = [("u", 1.0004, None, 2, "b"), ("u", 1.0001, None, 3, "c"), ("u", 1.0005, None, 1, "a"), ("u", 5.0, 7, 4, "d"), ("u", 5.0, 7, 5, "e")]
    frame = spark.createDataFrame(rows, "uid string, epoch_s double, row_index long, n int, v string")
    assert {r["v"] for r in ordering.strict_order(frame, arrival="n").collect()} == {"a", "d"}
    one = {r["v"] for r in ordering.strict_order(frame).collect()}
    assert one == {r["v"] for r in ordering.strict_order(frame.repartition(3)).collect()}


def test_next_probability_of_unseen_pairs(spark):
    from gapwise.operators import statistics as T

    trans = spark.createDataFrame([("a", "b", 3, 0.75), ("a", "c", 1, 0.25)], "context string, target string, n long, p double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "z"), ("y", "b")], "context string, target string")
    for normalize, want in ((False, [0.75, 0.2, 0.2]), (True, [0.75 / 1.6, 0.2 / 1.6, 0.2])):
        got = {(r["context"], r["target"]): r["p"] for r in T.next_token_probability(trans, pairs, F.lit(5), normalize).collect()}
        assert [got[k] for k in (("a", "b"), ("a", "z"), ("y", "b"))] == pytest.approx(want)
