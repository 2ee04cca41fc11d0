"""A stream in several triggers gives what the batch operator gives."""

import pytest
from pyspark.sql import functions as F

from gapwise.operators import features as X
from gapwise.operators import latches as L
from gapwise.operators.ordering import delta_labels
from gapwise.operators.sessions import sessions_in_arrival_order
from gapwise.plans.views import events
from gapwise.streaming import stateful as T
from gapwise.streaming.runner import run_available


@pytest.fixture(scope="module")
def pieces(spark, sf, tmp_path_factory):
    """The log in four files in time order, and the same rows as one table."""
    import time

    base = str(tmp_path_factory.mktemp("log"))
    e = events(spark, sf).select("uid", "session_id", "epoch_s", "row_index", "op_category", "value")
    for i in range(4):
        e.where((F.col("row_index") >= i * 250) & (F.col("row_index") < (i + 1) * 250)).coalesce(1).write.mode("append").parquet(base)
        time.sleep(1.1)  # file times order the triggers
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(base)


def same(a, b, cols):
    def rows(d):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.select(*cols).fillna(-1e9).collect())

    assert rows(a) == rows(b)


def test_sessions(spark, pieces):
    batch, stream = pieces
    out = run_available(T.stream_sessions(stream, idle=43200.0, key=b"k" * 32))
    want = sessions_in_arrival_order(batch, idle=43200.0, key=b"k" * 32)
    same(out, want, ["row_index", "split_reason", "delta_seconds", "session_sequence", "session_index", "generated_session_id"])


def test_features(spark, pieces):
    batch, stream = pieces
    out = run_available(T.stream_features(stream, 0.5, 60.0, 172800.0, window=3))
    want = X.gap_features(delta_labels(batch, ["uid", "session_id"], epsilon=0.5, epsilon_t=60.0), 0.5, 172800.0, window=3)
    same(out, want, ["row_index", "time_label", "delta_seconds", "session_sequence", "delta_log_burst", "delta_m25", "delta_m50", "delta_m75"])


def test_ratio_latch(spark, pieces):
    batch, stream = pieces
    add = {"flag": F.col("value") > 40, "s": F.col("value") / 40}
    out = run_available(T.stream_ratio_latch(stream.withColumns(add), ["uid"], ["epoch_s", "row_index"], "flag", "s", 2, 4, 1.1))
    want = L.ratio_latch(batch.withColumns(add), ["uid"], ["epoch_s", "row_index"], "flag", "s", 2, 4, 1.1)
    same(out, want, ["row_index", "votes", "alarm"])


def test_scores_without_refit(spark, pieces):
    batch, stream = pieces
    add = {
        "entry": F.col("op_category"), "delta_seconds": F.col("value"), "log_dt": F.ln("value"), "u": F.lit(3.0), "xi": F.lit(0.1),
        "beta": F.lit(0.3), "p_ref": F.lit(0.1), "q_star": F.lit(0.05),
    }
    cols = ["entry", "row_index", "delta_seconds", "log_dt", "u", "xi", "beta", "p_ref", "q_star"]
    out = run_available(T.stream_scores(stream.withColumns(add).select(*cols), k=2, n=4, every=0))
    from gapwise.functions.tails import adaptive_level

    level = F.exp(adaptive_level(3.0, 0.1, 0.3, 0.1, 0.05))
    rows = batch.withColumns(add).withColumn("s_evt", F.col("delta_seconds") / level).select("entry", "row_index", "s_evt")
    want = L.clearing_latch(rows, ["entry"], ["row_index"], "s_evt", 2, 4, 1.1)
    same(out, want, ["row_index", "s_evt", "alarm"])


def test_refit_happens(spark, pieces):
    _, stream = pieces
    add = {
        "entry": F.lit("all"), "delta_seconds": F.col("value"), "log_dt": F.ln("value"), "u": F.lit(3.0), "xi": F.lit(0.1),
        "beta": F.lit(0.3), "p_ref": F.lit(0.1), "q_star": F.lit(0.05),
    }
    cols = ["entry", "row_index", "delta_seconds", "log_dt", "u", "xi", "beta", "p_ref", "q_star"]
    out = run_available(T.stream_scores(stream.withColumns(add).select(*cols), every=300, min_tail=20))
    refits = [r["row_index"] for r in out.where("refit").orderBy("row_index").collect()]
    assert refits and refits[0] == 299


def test_open_session_waits(spark, pieces):
    batch, stream = pieces
    rows = stream.withColumn("ts", F.timestamp_micros(F.round(F.col("epoch_s") * 1e6).cast("long")))
    keep = ["uid", "session_id", "epoch_s", "row_index", "ts"]
    out = run_available(T.stream_closed_session_rows(rows.select(*keep), "uid", "session_id", ["epoch_s", "row_index"], 1e9))
    last = batch.groupBy("uid").agg(F.max_by("session_id", "epoch_s").alias("last"))
    want = batch.join(last, "uid").where("session_id <> last")
    same(out, want, ["row_index", "session_id"])
