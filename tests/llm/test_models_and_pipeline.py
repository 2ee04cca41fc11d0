"""Language, quality, the pipeline's stages against plain versions."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from gapwise.llm import langid, quality

from llm_brute import base_spans, jaccard_classes, leaks

BIG = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet")


def test_language(spark, docs):
    got = {r["doc_id"]: r for r in langid.learn_and_identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97


def test_sample_is_bounded_whatever_is_copied(spark):
    """A hot text gives one row of the sample; no language has more than its quota."""
    hot = spark.range(30_000).selectExpr("'en' AS lang", "'the same text' AS text")
    other = spark.range(3_000).selectExpr("'fr' AS lang", "concat('texte ', id) AS text")
    odd = spark.createDataFrame([("de", None), ("de", ""), ("de", None)], "lang string, text string")
    got = langid.draw(hot.union(other).union(odd), 100).collect()
    by = {k: [r for r in got if r["lang"] == k] for k in ("en", "fr", "de")}
    assert [len(by[k]) for k in by] == [1, 100, 1]
    least = sorted(langid.draw(other, 10).collect(), key=lambda r: r["digest"])
    assert least == sorted(by["fr"], key=lambda r: r["digest"])[:10]


def plain_train(rows, classes):
    """The update rule weight by weight, without arrays."""
    z, n = {}, {}

    def weight(c, i):
        s, t = z.get((c, i), 0.0), n.get((c, i), 0.0)
        if abs(s) <= langid.L1:
            return 0.0
        return -(s - (1 if s > 0 else -1) * langid.L1) / ((langid.BETA + t**0.5) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for at, x, y in rows:
            w = {(c, i): weight(c, i) for c in range(classes) for i in at}
            e = [np.exp(sum(w[c, i] * v for i, v in zip(at, x, strict=True))) for c in range(classes)]
            for c in range(classes):
                for i, v in zip(at, x, strict=True):
                    g = (e[c] / sum(e) - (c == y)) * v
                    t = n.get((c, i), 0.0)
                    z[c, i] = z.get((c, i), 0.0) + g - ((t + g * g) ** 0.5 - t**0.5) / langid.ALPHA * w[c, i]
                    n[c, i] = t + g * g
    return {k: weight(*k) for k in z}


def test_weights_against_plain_loops():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(30)]
    got, want = langid.train(rows, 3), plain_train(rows, 3)
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-12)
    assert 0 < np.count_nonzero(got) <= sum(v != 0 for v in want.values())


def test_language_of_odd_texts(spark):
    rows = [(1, None, "en"), (2, "😀 12 .", "en"), (3, "", None), (None, "the house", None), (4, "the house of the man " * 20, "en"), (5, "la maison de la reine " * 20, "fr"), (4, "the house " * 20000, "en")]
    frame = spark.createDataFrame([(i, t, g, "s", 1, 0.5, 1) for i, t, g in rows], DOCS)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.learn_and_identify(frame, folds=1000).collect()]
    assert len(got) == len(rows)
    assert {(i, p, s) for i, p, s in got if i in (1, 2, 3)} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert langid.learn_and_identify(frame.limit(0)).count() == 0


def test_temperature_is_finite_without_errors():
    logits = np.array([[9.0, 0.0], [0.0, 9.0]] * 50)
    t = langid.temperature(logits, np.array([0, 1] * 50))
    assert langid.softmax(logits / t).max() < 1


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.learn_and_score(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [i for i in truth if i in got and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97


def test_discriminant_formula():
    """Scores equal the log density difference computed with the inverse covariances."""
    rng = np.random.default_rng(3)
    p = len(quality.STATISTICS)
    means, low = rng.normal(size=(2, p)), [np.linalg.cholesky(np.eye(p) * (1 + c) + 0.1) for c in (0, 1)]
    model = quality.Discriminant(np.zeros(p), np.ones(p), means, np.array([np.linalg.inv(m) for m in low]), np.array([np.log(0.3) - np.log(np.diag(low[0])).sum(), np.log(0.7) - np.log(np.diag(low[1])).sum()]))
    x = rng.normal(size=(20, p))
    want = []
    for c, share in ((0, 0.3), (1, 0.7)):
        cov = low[c] @ low[c].T
        z = x - means[c]
        want.append(np.log(share) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(want[0] - want[1])))


def test_quality_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 100000), (3, "x " * 100000)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 0.25, 1) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.learn_and_score(frame, labels).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    kept = quality.keep_good(frame, labels)
    assert kept.count() == 5 and kept.columns == frame.columns
    assert quality.learn_and_score(frame.limit(0), labels).count() == 0 and quality.keep_good(frame.limit(0), labels.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline


@pytest.fixture(scope="module")
def outputs(spark, docs, tmp_path_factory):
    folder, found, now = tmp_path_factory.mktemp("stages"), [docs], docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, BIG).write.parquet(str(folder / str(n)))
        now = spark.read.parquet(str(folder / str(n)))
        found.append(now)
    return [[r.asDict() for r in f.collect()] for f in found]


def test_columns(docs, outputs):
    for rows in outputs[1:-1]:
        assert list(rows[0]) == docs.columns


def test_quality_stage(spark, outputs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in outputs[1]}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in good]) > 0.98
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.05


def test_duplicate_stage(outputs):
    rows = [(r["doc_id"], r["text"]) for r in outputs[1]]
    _, root = jaccard_classes(rows)
    least: dict[int, int] = {}
    for (doc, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, doc), doc)
    assert sorted(r["doc_id"] for r in outputs[2]) == sorted(least.values())


def test_benchmark_stage(spark, outputs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in outputs[3]) == sorted(r["doc_id"] for r in outputs[2] if not leaks(r["text"], items))


def test_personal_data_stage(outputs):
    before = {r["doc_id"]: r["text"] for r in outputs[3]}
    assert len(outputs[4]) == len(outputs[3])
    for r in outputs[4]:
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not base_spans(before[r["doc_id"]]) and "[" not in r["text"]:
            assert r["text"] == before[r["doc_id"]]


def test_mixing_stage(outputs):
    known = {r["doc_id"]: r["text"] for r in outputs[4]}
    assert abs(len(outputs[5]) - len(known)) < 6 * len(known) ** 0.5
    assert all(known[r["doc_id"]] == r["text"] for r in outputs[5])


def test_empty_input(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, BIG)
    assert now.count() == 0
