"""Every registered query against its SQL twin; queries without one must give rows."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    bad, _ = differences(QUERIES[name](spark, sf), con, ORACLES[name])
    assert not bad, bad


# the tail models need a few dozen rows above the base level
BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["t9_bimodality", "t15_spot_threshold", "t16_calibrate", "t17_tail_fit", "e15_temperature", "e17_bootstrap_interval", "g9_cross_validation", "st3_stream_scores"])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, BIG).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 15
