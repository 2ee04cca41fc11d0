"""Plans keep the shape they were written for."""

from gapwise.operators.sessions import session_table
from gapwise.plans import registry
from gapwise.plans.views import gaps, sessions

import __spark_entry__ as entry

entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_session_windows_share_one_shuffle(spark, sf):
    text = plan(sessions(spark, sf))
    assert text.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in text


def test_scan_reads_needed_columns_only(spark, sf):
    text = plan(gaps(spark, sf).select("uid", "delta_seconds"))
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema and "value" not in schema and "event_type" not in schema


def test_filter_reaches_the_scan(spark, sf):
    from gapwise.plans.views import events

    text = plan(events(spark, sf).where("value > 50"))
    assert "GreaterThan(value,50.0)" in text


def test_no_python_in_hot_paths(spark, sf):
    for name in ("w9_rolling_quantiles", "w18_protocol_rules", "l2_ratio_latch", "t14_tail_by_moments", "c10_hazard_scores", "p10_token_uid"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert "Python" not in text and "Pandas" not in text, name


def test_session_table_aggregates_before_shuffling(spark, sf):
    text = plan(session_table(sessions(spark, sf), session="sid"))
    assert "partial_min" in text


def test_no_cross_join(spark, sf):
    for name in ("p13_standardise", "a11_alarm_budget", "e10_calibration_error", "g2_rolling_origin", "j8_interval_antijoin", "w17_rotation_audit"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
