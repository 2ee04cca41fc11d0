"""Repetition, decontamination, personal data, mixing."""

import hashlib
import random
from collections import Counter
from math import exp

import pytest

from gapwise.llm import decontaminate, mixing, pii, repetition

from llm_brute import base_spans, leaks, repeats, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, count int, key string, item_id long"


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 1, "k", 5) for i, t in enumerate(texts)], DOCS)


# ------------------------------------------------------------------ repetition


def test_repeats_match_brute_force():
    rng = random.Random(1)
    for least in (3, 5, 8):
        for _ in range(40):
            texts = [[rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 6))]
            got = list(zip(*(x.tolist() for x in repetition.measure(texts, least)), strict=True))
            assert got == [repeats(t, least) for t in texts]


def test_rules(spark):
    good = " ".join(f"w{i}" for i in range(300))
    block = " ".join(f"r{i}" for i in range(60))
    texts = [good, good[:20], "", None, "a " * 40, f"{good}\n{block}\n{' '.join(f'x{i}' for i in range(200))}\n{block}", "l m\nl m\n \n\nl m # $", "é ü " * 3 + good, "x " * 30000 + good]
    got = {r["doc_id"]: r for r in repetition.rules(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts[:-1]):
        w, r = words(t), got[i]
        window, covered, longest = repeats(w, repetition.MIN_REPEAT)
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r["n_dup_lines"], r["n_repeat_words"], r["n_covered_words"], r["longest_repeat"]) == (len(lines) - len(set(lines)), window, covered, longest)
        assert r["base_failed"] == (len(w) < 10 or 100 * window > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert got[0]["kept"] and got[7]["kept"] and not got[5]["kept"] and not got[8]["kept"]
    assert repetition.rules(docs_of(spark, [])).count() == 0


def test_long_repeat_rejects(spark):
    """A repeat of over 50 words fails a text that the base rules let pass."""
    block = [f"r{i}" for i in range(55)]
    text = " ".join([f"a{i}" for i in range(220)] + block + [f"b{i}" for i in range(200)] + block)
    (r,) = repetition.rules(docs_of(spark, [text])).collect()
    assert not r["kept"]
    assert r["base_failed"] or r["longest_repeat"] == 55


def test_rules_add_to_the_base(spark):
    """A long passage twice in a very long text, and many repeats of 12 words, fail texts that the base rules let pass."""
    run = lambda k, n: [f"{k}{i}" for i in range(n)]
    passage = run("p", 900)
    long = run("a", 9000) + passage + run("b", 9200) + passage
    many = [w for j in range(10) for w in run(f"s{j}_", 12) + run(f"c{j}_", 66) + run(f"s{j}_", 12) + run(f"d{j}_", 66)]
    few = run("e", 400) + many[:300]
    got = {r["doc_id"]: r for r in repetition.rules(docs_of(spark, [" ".join(x) for x in (long, many, few)])).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [got[i]["longest_repeat"] for i in range(3)] == [900, 12, 12]
    assert [got[i]["kept"] for i in range(3)] == [False, False, True]


# ------------------------------------------------------------------ decontamination


def test_leaks(spark):
    item = " ".join(f"q{i}" for i in range(30))
    tiny, other = "what is it", " ".join(f"z{i}" for i in range(12))
    items = [(1, item), (2, tiny), (3, None), (4, ""), (5, item), (None, other)]
    noise = " ".join(f"n{i}" for i in range(4000))
    texts = [f"{noise} {item} {noise}", item, tiny, f"x {tiny} y", None, "", noise, item.replace("q15", "Q"), f"{item[:60]} {noise} {item[60:]}", f"{other} {noise}", item, item.upper()]
    bench = spark.createDataFrame([(*i, "k") for i in items], "item_id long, text string, hash string")
    docs = docs_of(spark, texts + [texts[0]])
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect())
    want = Counter((i, k) for i, t in enumerate([*texts, texts[0]]) for k in leaks(t, items))
    assert got == want and want[(0, 1)]
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate([*texts, texts[0]]) if not leaks(t, items)]
    assert decontaminate.find(docs.limit(0), bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    assert [r["doc_id"] for r in decontaminate.find(docs_of(spark, [item, "a b c d e f"]), bench).collect()] == [0]


def test_least_hits():
    k = decontaminate.least_hits(0.8)
    assert 1 <= k < decontaminate.FUNCTIONS * 0.8


# ------------------------------------------------------------------ personal data

TRICKY = [
    "", None, "a@b.c+d@e.f %x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3", "4207051279108084 5 4207051279108084", "+1 (649) 555-6111, +12 3",
    "é😀é x@y.com 😀 a@b.de", "call 555-123-4567", "a" * 3000, "1" * 3000, "1 " * 3000, "a@" + "b." * 2000 + "c", "....@@foo@bar.com", "x@y", "+4111 1111 1111 1111", "a@b.c" * 50,
]


def test_base_spans(spark):
    got = {r["doc_id"]: r for r in pii.report(pii.find(docs_of(spark, TRICKY))).collect()}
    assert len(got) == len(TRICKY)
    for i, t in enumerate(TRICKY):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}


def test_very_long_runs(spark):
    """Linear time and constant stack on long runs."""
    texts = ["1" * 300_000, "1 " * 200_000, "a" * 400_000, "1." * 200_000, "+1" + " " * 200_000, "a@" + "b." * 100_000]
    got = pii.report(pii.find(docs_of(spark, texts))).collect()
    assert len(got) == len(texts)


def test_base_spans_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.report(pii.find(docs)).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_redact(spark):
    docs = docs_of(spark, TRICKY)
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert got[1]["text"] is None and got[0]["text"] == ""
    assert got[5]["text"].startswith("[PHONE], ") and got[6]["text"] == "é😀é [EMAIL] 😀 [EMAIL]"
    for i, r in got.items():
        assert not base_spans(r["text"]) or i == 12
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert pii.redact(docs_of(spark, [])).count() == 0


def test_glued_cards_are_added(spark):
    """The classifier, trained without labels, takes card numbers that other digits hide and leaves random numbers."""
    valid = ["4111111111111111", "5500005555555559", "4207051279108084"]
    texts = [f"pay {v} now" for v in valid * 20] + [f"serial {10**15 + 7 * k} x" for k in range(60)] + ["seen 4111111111111111 5500005555555559 today"]
    last = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(docs_of(spark, texts))).collect()}
    assert last[len(texts) - 1] == "card:5:21,card:22:38"
    assert [s for i, s in last.items() if 60 <= i < 120 and s and not base_spans(texts[i])] == []


# ------------------------------------------------------------------ mixing


def brute_mix(rows, alpha=mixing.ALPHA, seed=mixing.SEED):
    n = Counter(s for _, s, _ in rows)
    whole = sum(v**alpha for v in n.values())
    out = []
    for doc, source, text in rows:
        rate = n[source] ** alpha / whole * len(rows) / n[source]
        key = str(doc) if doc is not None else hashlib.md5((text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, exp(-rate), exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [(doc, i + 1) for i in range(k)]
    return sorted(out, key=str)


def test_mix(spark):
    rows = [(i, "a" if i % 3 == 0 else "b" if i % 50 else None, f"t{i}") for i in range(400)] + [(None, "a", "x"), (None, "a", None), (7, "b", "again")]
    docs = spark.createDataFrame([(d, t, "en", s, 1, 1, "k", 5) for d, s, t in rows], DOCS)
    got = mixing.mix(docs)
    assert sorted(((r["doc_id"], r["copy"]) for r in got.collect()), key=str) == brute_mix(rows)
    assert got.columns == [*docs.columns, "copy"]
    only = mixing.mix(docs, weights={"a": 3.0, None: 1.0}, total=4000).collect()
    share = Counter(r["source"] for r in only)
    assert set(share) == {"a", None} and abs(share["a"] - 3000) < 300 and abs(share[None] - 1000) < 250
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, weights={}).count() == 0


def test_large_rates(spark):
    docs = spark.createDataFrame([(1, "t", "en", "a", 1, 1, "k", 5)], DOCS)
    n = mixing.mix(docs, weights={"a": 1.0}, total=5000).count()
    assert abs(n - 5000) < 500


@pytest.mark.parametrize("operator", [lambda d: mixing.mix(d), lambda d: pii.redact(d)])
def test_clashing_columns_keep_their_values(spark, operator):
    docs = docs_of(spark, ["a b c"] * 20)
    assert {(r["count"], r["key"]) for r in operator(docs).collect()} == {(1, "k")}
