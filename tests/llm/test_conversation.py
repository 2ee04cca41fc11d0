"""Conversation repair against a plain shortest path search."""

import random

import pytest
from llm_brute import conversation_report

from gapwise.llm import conversation

FORM = "conv_id long, turn long, role string, text string"


def report(df, **kw):
    out = conversation.repair(conversation.damage(df), **kw)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def some(seed, convs, most, null=0.03):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "Fine. ", "a\nb.", "été", None]
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randint(1, most)):
            turn = None if rng.random() < null else t if rng.random() < 0.9 else rng.randint(0, 9)
            text = rng.choice(texts) if rng.random() < 0.4 else f"Row {rng.randint(0, 99)}" + rng.choice([".", "!", "?", ""])
            rows.append((c, turn, rng.choice(roles[:2] if rng.random() < 0.8 else roles), text))
    rng.shuffle(rows)
    return rows + rows[::17]


def test_equals_shortest_paths(spark):
    rows = some(1, 300, 12)
    assert report(spark.createDataFrame(rows, FORM)) == conversation_report(rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()]
    assert report(docs.withColumn("conv", docs["role"]).withColumn("copies", docs["turn"])) == conversation_report(rows)


@pytest.mark.parametrize("block, fan", [(3, 2), (7, 256)])
def test_long_conversations_in_blocks(spark, block, fan):
    rows = some(2, 12, 90)
    assert report(spark.createDataFrame(rows, FORM), block=block, fan=fan) == conversation_report(rows)


def test_hot_conversation_is_cut(cut):
    rows = [(c % 3 if c % 2 else 7, t, r, x) for c, t, r, x in some(3, 40, 12) if c is not None]
    assert report(cut.createDataFrame(rows, FORM), block=5) == conversation_report(rows)


def test_empty_table_and_dropped_rows(spark):
    assert report(spark.createDataFrame([], FORM)) == {}
    rows = [(c, 0, "user", "Hi.") for c in range(200)]
    found = report(spark.createDataFrame(rows, FORM))
    assert found == conversation_report(rows) and any(v[6] == "" for v in found.values())


def test_many_copies_of_one_row_and_a_very_long_text(spark):
    rows = [(1, 5, "user", "Again.")] * 3000 + [(1, 6, "assistant", "word " * 200_000 + ".")]
    assert report(spark.createDataFrame(rows, FORM)) == conversation_report(rows)


def test_prices_are_distances_and_linear():
    symbols = "".join(random.Random(4).choice("suaxSUAXd") for _ in range(5000))
    steps, state, cost = conversation.trace(symbols, conversation.GOAL, 0)
    assert state in (0, 3) and len(steps) == 5001
    m = conversation.matrix(symbols)
    assert min(m[0], m[3]) == cost
