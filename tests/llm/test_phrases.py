"""Phrase mining against its SQL twin on odd rows, ties and exact scores beyond 64 bits."""

import random

import duckdb
import pytest
from compare import canonical

from gapwise.llm import phrases

FORM = "doc_id long, text string, lang string, word int"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_sql(rows, **kw):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, word INT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return canonical(NAMES, con.execute(phrases.mine_sql(**kw)).fetchall())


def mined(spark, rows, **kw):
    found = phrases.mine(spark.createDataFrame(rows, FORM), **kw)
    assert found.columns == NAMES
    return canonical(NAMES, [tuple(r) for r in found.collect()])


def some(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "été", "É", "a", "b", "c", " x", "日本"]
    ends = [" ", " ", "  ", "\t", ", ", ".", "\n", " ! ", "\x0b", "a"]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice([None, 1, i]), rng.choice([None, "", text(), text(), text()]), rng.choice(["en", "fr", None]), 0) for i in range(n)]
    return rows + rows[:20] * 3


@pytest.mark.parametrize("kw", [{}, {"least": 2, "top": 15}, {"least": 40, "top": 3}])
def test_equals_sql(spark, kw):
    rows = some(5, 150)
    assert mined(spark, rows, **kw) == by_sql(rows, **kw)


def test_no_phrase_and_empty_table(spark):
    assert mined(spark, [])[1] == []
    assert mined(spark, [(1, "just one text of a few words", "en", 0)])[1] == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gapwise_")]


def test_one_very_long_text_and_one_hot_phrase(spark):
    rows = [(1, "ab cd " * 30_000, "en", 0)] + [(2, "same words again", "en", 0)] * 500
    assert mined(spark, rows) == by_sql(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 3_000_000_023, 3_000_000_029
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert phrases._scored(df, "score", "l", "r").first()["score"] == 10**6 * a * a // (left * right)


def test_texts_of_a_language_lie_in_few_even_buckets(spark):
    rows = [(i, f"some words of text {i % 7}", ["en", "fr", None, f"rare{i}"][i % 4], 0) for i in range(1600)]
    texts = phrases._texts(spark.createDataFrame(rows, FORM), 8).select("bucket", "lang").collect()
    sizes, of = {}, {}
    for r in texts:
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
        of.setdefault(r["lang"], set()).add(r["bucket"])
    assert len(texts) == 1600 and len(sizes) == 8 and max(sizes.values()) < 1.5 * min(sizes.values())
    assert all(len(of[lang]) <= 4 for lang in ("en", "fr", "und"))
