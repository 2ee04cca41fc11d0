"""Callbacks over groups that are larger than one batch."""

import pandas as pd
import pytest

from gapwise.operators.groups import for_each_group

FORM = "k string, j long, t long, x double"


@pytest.fixture(params=[3, 10_000])
def small_batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows():
    out = [(["a", "b", None][i % 3], [1, None][i % 2], (i * 37) % 101, float(i)) for i in range(101)]
    return [*out, ("single", 5, 0, 1.5)]


def expected():
    by = {}
    for k, j, t, x in sorted(rows(), key=lambda r: r[2]):
        by.setdefault((k, j), []).append((t, x))
    return by


def test_state_crosses_batches(small_batches):
    def running(key, frames):
        total = 0.0
        for frame in frames:
            at = frame["x"].cumsum() + total
            total = float(at.iloc[-1])
            yield frame.assign(total=at)

    got = for_each_group(small_batches.createDataFrame(rows(), FORM), ["k", "j"], ["t"], running, FORM + ", total double").collect()
    assert len(got) == len(rows())
    want = {}
    for key, values in expected().items():
        total = 0.0
        for t, x in values:
            total += x
            want[(*key, t, x)] = total
    assert {(r["k"], r["j"], r["t"], r["x"]): r["total"] for r in got} == pytest.approx(want)


def test_one_call_per_group_also_when_frames_are_left(small_batches):
    def first(key, frames):
        frame = next(frames)
        yield pd.DataFrame({"k": [key[0]], "j": [key[1]], "t": [int(frame["t"].iloc[0])]})

    got = for_each_group(small_batches.createDataFrame(rows(), FORM), ["k", "j"], ["t"], first, "k string, j double, t long").collect()
    assert sorted(map(str, ((r["k"], r["j"], r["t"]) for r in got))) == sorted(
        str((k, None if j is None else float(j), v[0][0])) for (k, j), v in expected().items()
    )


def test_callback_that_yields_nothing_and_empty_table(small_batches):
    nothing = lambda key, frames: iter(())
    assert for_each_group(small_batches.createDataFrame(rows(), FORM), ["k"], ["t"], nothing, FORM).collect() == []
    assert for_each_group(small_batches.createDataFrame([], FORM), ["k"], ["t"], nothing, FORM).collect() == []
