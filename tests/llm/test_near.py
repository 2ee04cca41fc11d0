import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapwise.llm import near
from gapwise.llm.common import components, shingle_set, shingles

from llm_brute import jaccard_classes
from llm_brute import shingles as brute_shingles

SCHEMA = "doc_id long, text string, n int, key string"


def variant(words, at):
    return " ".join(w if i not in at else f"{w}x" for i, w in enumerate(words))


@pytest.fixture(scope="module")
def rows():
    base = [f"w{i}" for i in range(120)]
    other = [f"v{i}" for i in range(60)]
    texts = [variant(base, {k, k + 1} if k else set()) for k in range(0, 100, 7)]
    texts += [variant(base, set(range(0, 120, 9)))]  # too far
    texts += [" ".join(other), " ".join(other), "  ".join(other) + "\n", variant(other, {59})]
    texts += ["short one", "short one", "short two", "", " \n\t", None, "a b c d e", "a b c d e f"]
    texts += [" ".join(base * 150)]  # very long
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[16]), (None, None)]


def test_classes_and_links(spark, rows):
    got = near.similar_classes(spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    links, root = jaccard_classes(rows)
    want = []
    for i, (doc, text) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        alone = sum(r == root[i] for r in root) == 1
        want.append((doc, doc if alone else min(ids, default=None), links[i]))
    assert sorted(((r["id"], r["class_id"], r["n_links"]) for r in got), key=str) == sorted(want, key=str)


def test_one_of_each_stays(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    got = near.keep_one(docs)
    assert got.columns == docs.columns
    _, root = jaccard_classes(rows)
    single = {r[0] for i, r in enumerate(rows) if root.count(root[i]) == 1 and r[0] is not None}
    kept = [r["doc_id"] for r in got.collect()]
    assert single <= set(kept)
    texts = [r["text"] for r in got.collect() if (r["text"] or "").split()]
    again, _ = jaccard_classes([(i, t) for i, t in enumerate(texts)])
    assert not any(again)
    assert len(kept) == len(set(root)) - 0


def test_empty_and_blank(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near.similar_classes(docs).count() == 0 and near.keep_one(docs).count() == 0
    docs = spark.createDataFrame([(1, None, 1, "k"), (2, "", 1, "k")], SCHEMA)
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in near.similar_classes(docs).collect()) == [(1, 1, 0), (2, 2, 0)]


def test_blocks_lose_no_link(spark, monkeypatch):
    """A group over several blocks gives the links of one block."""
    monkeypatch.setattr(near, "BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, variant(base, {k, k + 100})) for k in range(0, 60, 2)]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in near.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links, root = jaccard_classes(rows)
    assert got == {d: (rows[root[i]][0], links[i]) for i, (d, _) in enumerate(rows)}


def test_two_blocks_of_long_texts():
    """Between two blocks a pair just below the threshold has no link, one just above it has."""
    import pyarrow as pa

    every = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 25_000, dtype=np.int64)
    left, below, above = every[:20_000], every[20_000 - 17_775 : 40_000 - 17_775], every[20_000 - 17_780 : 40_000 - 17_780]
    for right, links in ((below, 0), (above, 1)):
        rows = [{"root": b"r", "p": 0, "q": 1, "block": k, "key": b"%d" % k, "copies": 1, "shingles": np.sort(x).tolist()} for k, x in enumerate((left, right))]
        schema = pa.schema([("root", pa.binary()), ("p", pa.int64()), ("q", pa.int64()), ("block", pa.int64()), ("key", pa.binary()), ("copies", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        got = [r for b in near._verify(near.SIMILARITY)(iter([pa.RecordBatch.from_pylist(rows, schema)])) for r in b.to_pylist()]
        assert [(r["texts"], r["docs"]) for r in got] == [(1, 1)] * 2 * links


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in near.similar_classes(docs).collect()}
    links, root = jaccard_classes(rows)
    assert got == {d: (min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]), links[i]) for i, (d, _) in enumerate(rows)}


def test_signature_estimates_similarity():
    every = np.random.default_rng(1).integers(0, 2**64, 1200, dtype=np.uint64)
    x, y = np.unique(every[:1000]), np.unique(every[200:])
    share = (near.signature(x) == near.signature(y)).mean()
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs(share - true) < 0.15
    assert near.meets(0.8, 5) > 0.999 > near.meets(0.8, 8)


@pytest.mark.parametrize("copies", [0, 400])
def test_large_group_hides_no_pair(spark, copies):
    """Pairs that meet only at the guaranteed depth are proposed, with and without a group of copies that meets at once."""
    rng = np.random.default_rng(3)
    label = lambda *n: rng.integers(0, 2**32, (*n, near.TREES, near.DEPTH), dtype=np.uint32)
    signs, (one,) = [], label(1)
    for _ in range(copies):
        signs.append(one.copy())
        signs[-1][:, 7] = label()[:, 7] * (rng.random(near.TREES) < 0.3) + one[:, 7]
    for x in label(20):
        y = x.copy()
        y[:, 5] += np.uint32(1)
        signs += [x, y]
    rows = [(i.to_bytes(4, "big"), x.tobytes()) for i, x in enumerate(signs)]
    got = near.candidates(spark.createDataFrame([(bytearray(k), bytearray(x)) for k, x in rows], "key binary, sign binary")).collect()
    met = {frozenset(int.from_bytes(r[c], "big") for c in "ab") for r in got}
    assert all(frozenset((i, i + 1)) in met for i in range(copies, len(rows), 2))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b\xa0", max_size=40))
def test_shingle_set_counts_distinct_shingles(text):
    assert len(shingle_set(text)) == len(brute_shingles(text))


def test_sql_shingles(spark):
    from pyspark.sql import functions as F

    texts = ["", None, "a", "a b\tc", "a b c d e", "a b c d e f a b c d e", "é\xa0x \x0b y"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", shingles(F.col("t")).alias("s")).collect()
    for r in got:
        assert {tuple(s.split(" ")) for s in r["s"]} == brute_shingles(texts[r["i"]])
