import pytest
from pyspark.sql import functions as F

from gapwise.operators import contract as C
from gapwise.plans.views import events
from gapwise.sources import logs, provenance, sinks


def test_csv_rows_are_numbered_by_file(spark, tmp_path):
    head = ",".join(C.LOG_COLUMNS)
    for name, n in (("b", 3), ("a", 50), ("c", 1)):
        body = "\n".join(f"{i},u{name}{i},s,GET,/x,,ua,1.2.3.4,c,READ" for i in range(n))
        (tmp_path / f"{name}.csv").write_text(f"{head}\n\n{body}\n")
    rows = logs.read_log_csv(spark, [str(tmp_path)]).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(54))
    assert [r["uid"] for r in rows] == [f"ua{i}" for i in range(50)] + [f"ub{i}" for i in range(3)] + ["uc0"]


def test_missing_column_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp_utc,uid\n1,u\n")
    with pytest.raises(ValueError, match="missing columns"):
        logs.read_log_csv(spark, str(tmp_path))


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿".encode() + (",".join(C.LOG_COLUMNS) + "\n1,u,s,GET,/x,,ua,1.2.3.4,c,READ\n").encode())
    assert logs.read_log_csv(spark, str(tmp_path)).first()["timestamp_utc"] == "1"


def test_forbidden_columns(spark):
    df = spark.createDataFrame([("x",)], "jwt string")
    with pytest.raises(ValueError, match="forbidden"):
        C.canonical(df)


def test_manifest_notices_changes(spark, sf):
    e = events(spark, sf).withColumn("source", F.lit("a")).select("source", "row_index", "uid")
    m = provenance.source_manifest(e, "source", ["row_index", "uid"])
    provenance.assert_same_manifest(m, provenance.source_manifest(e.repartition(5), "source", ["uid", "row_index"]))
    other = e.withColumn("uid", F.when(F.col("row_index") == 7, "changed").otherwise(F.col("uid")))
    with pytest.raises(ValueError):
        provenance.assert_same_manifest(m, provenance.source_manifest(other, "source", ["row_index", "uid"]))
    with pytest.raises(ValueError):
        provenance.assert_same_fold("fold_0", "fold_1")


def test_stats_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("key", "u", 1, 2.0, 0.0, None)], "level string, uid string, hour int, x_med double, x_mad double, x_smad double")
    sinks.save_stats(s, str(tmp_path / "s"))
    r = sinks.load_stats(spark, str(tmp_path / "s")).first()
    assert r["x_smad"] == 1e-12 and r["x_med"] == 2.0


def test_stats_keep_epsilon_and_fill_hours(spark, tmp_path):
    rows = [
        ("global", None, None, None, 5.0, 1.0, None, 9), ("global", None, None, 3, 6.0, None, None, 2),
        ("key", "u", "s", None, 2.0, 0.5, 0.7, 4), ("key", "u", "s", 7, 3.0, 0.1, 0.2, 1), ("key", "v", None, 7, 4.0, 0.0, 0.0, 1),
    ]
    s = spark.createDataFrame(rows, "level string, uid string, session_id string, hour int, x_med double, x_mad double, x_smad double, n long")
    sinks.save_stats(s, str(tmp_path / "s"), epsilon=0.5)
    back = sinks.load_stats(spark, str(tmp_path / "s"))
    assert back.columns == [*s.columns, "epsilon"]
    got = {(r["uid"], r["session_id"], r["hour"]): (r["x_med"], r["x_mad"], round(r["x_smad"], 12), r["epsilon"]) for r in back.collect()}
    want = {(u, k, h): x for u, k, x in ((None, None, (5.0, 1.0, 1.4826, 0.5)), ("u", "s", (2.0, 0.5, 0.7, 0.5))) for h in (None, *range(24))}
    want |= {(None, None, 3): (6.0, 1.0, 1.4826, 0.5), ("u", "s", 7): (3.0, 0.1, 0.2, 0.5), ("v", None, 7): (4.0, 0.0, 1e-12, 0.5)}
    assert got == want
    sinks.save_stats(s, str(tmp_path / "t"), epsilon=0.0)
    assert {r["epsilon"] for r in sinks.load_stats(spark, str(tmp_path / "t")).collect()} == {1e-12}


@pytest.mark.parametrize("text,want", [
    ("1706745600", 1706745600.0), ("-3.5", -3.5), ("2024-02-01T00:00:00Z", 1706745600.0), ("2024-02-01T00:00:00.250+01:30", 1706740200.25),
    ("2024-02-30T00:00:00Z", None), ("2024-02-01T24:00:00Z", None), ("2024-02-01T00:00:00+24:00", None), ("2024-02-01", None), ("", None),
])
def test_timestamps(spark, text, want):
    from gapwise.functions.timestamps import parse_epoch

    got = spark.createDataFrame([(text,)], "t string").select(parse_epoch(F.col("t"))).first()[0]
    assert got == want
