"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters of the lower-cased text, other characters as one space, give n-grams of 1 to 3 characters, hashed to ``DIMENSIONS`` slots.
Document frequencies are counted over all rows to learn from.  The weights are trained by follow-the-regularised-leader
(FTRL-proximal) with an elastic-net penalty, whose first part makes them sparse, on a bounded sample: at most ``SAMPLE`` different
texts, shared evenly by the languages, chosen by a hash.  Copies of a text count once there, however many there are.  A fifth of the
sample is left out and sets the temperature that calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import in_pieces
from gapwise.scale import durable

DIMENSIONS, GRAMS = 2**15, 3
SAMPLE = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.05, 0.01
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each character of the basic plane is a letter."""
    return np.array([chr(i).isalpha() for i in range(2**16)])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of a whole text and their counts; none if it has no letter."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    alpha = _letters()[np.minimum(x, 0xFFFF)] & (x < 2**16)
    if not alpha.any():
        if not any(map(str.isalpha, text or "")):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        alpha = x > 0xFFFF
    x = np.where(alpha, x, 32).astype(np.uint64)
    x = np.concatenate(([32], x[(x != 32) | (np.concatenate(([0], x[:-1])) != 32)], [32])).astype(np.uint64)
    count = np.zeros(DIMENSIONS, np.int64)
    key = np.zeros(len(x), np.uint64)
    for n in range(1, GRAMS + 1):
        key = key[: len(x) - n + 1] * np.uint64(0x110000) + x[n - 1 :]
        slot = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        count += np.bincount(((slot ^ (slot >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(count)
    return at, count[at]


def weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF values."""
    x = (1 + np.log(count)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """FTRL-proximal weights (classes x slots) of rows (slots, values, class), taken in the given order."""
    z = np.zeros((classes, DIMENSIONS))
    n = np.zeros((classes, DIMENSIONS))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            z[:, at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = ns + g * g
    return weights(z, n)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Divisor of the logits with the least log loss on rows left out, from 0.05 to 5."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 93))
    # smoothed targets: rows without an error must not drive the scores to 1
    doubt = 1 / (len(y) + 2)
    loss = []
    for t in grid:
        logs = np.log(np.maximum(softmax(logits / t), 1e-300))
        own = logs[np.arange(len(y)), y]
        others = (logs.sum(1) - own) / max(1, logits.shape[1] - 1)
        loss.append(-((1 - doubt) * own + doubt * others).mean())
    return float(grid[int(np.argmin(loss))])


@dataclass(frozen=True)
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, count = grams(text)
        if not len(at) or not self.classes:
            return UNKNOWN, 0.0
        p = softmax(self.weights[:, at] @ weigh(at, count, self.idf) / self.heat)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per slot over all rows (column ``text``), and the number of rows with a letter."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = np.zeros(DIMENSIONS + 1, np.int64)
        for b in in_pieces(batches):
            for t in b.column(0).to_pylist():
                at, _ = grams(t)
                found[at] += 1
                found[-1] += bool(len(at))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["slot", "n"])

    sums = rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in sums.collect():  # at most one row per slot
        out[r["slot"]] = r["n"]
    return out[:-1], int(out[-1])


def draw(rows: DataFrame, quota: int) -> DataFrame:
    """At most ``quota`` different texts of each language: ``lang``, ``text`` and ``digest`` (of both), one row for all copies.

    A first draw by the digest leaves about twice the quota of each language, of which the least digests stay, so no task
    ranks more than that.
    """
    digest = F.md5(F.concat(F.col("lang"), F.lit(":"), F.coalesce("text", F.lit(""))))
    rows = rows.select("lang", "text", digest.alias("digest"))
    texts = durable(rows.select("lang", "digest").distinct())
    share = texts.groupBy("lang").agg((F.lit(2.0 * quota + 50) / F.count("*")).alias("share"))
    place = F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    # one row per language; joined before any exchange by language, so the draw happens where the texts are
    drawn = texts.join(F.broadcast(share), "lang").where(place < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    few = durable(drawn.select("lang", "digest", rank.alias("rank")).where(F.col("rank") <= quota).select("lang", "digest"))
    return rows.join(few, ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.first("text").alias("text")).select("lang", "text", "digest")


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from all rows (columns ``text``, ``lang`` not null); no rows give a model that knows no language."""
    classes = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # one row per language
    if not classes:
        return Model([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), 1.0)
    frequency, n = frequencies(rows)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    chosen = draw(rows, -(-sample // len(classes)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        data: list[tuple] = []
        for b in in_pieces(batches):
            for lang, text, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, count = grams(text)
                if len(at):
                    data.append((digest[::-1], at, weigh(at, count, idf), classes.index(lang)))
        data.sort(key=lambda r: r[0])
        kept = [r[1:] for r in data if int(r[0][0], 16) % 5]
        out = [r[1:] for r in data if not int(r[0][0], 16) % 5]
        w = train(kept, len(classes))
        logits = np.array([w[:, at] @ x for at, x, _ in out]).reshape(-1, len(classes))
        heat = temperature(logits, np.array([y for _, _, y in out], np.int64))
        c, at = np.nonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*c, -1]), pa.array([*at, 0]), pa.array([*w[c, at], heat])], ["class", "slot", "weight"])

    trained = chosen.repartition(1).mapInArrow(run, "class long, slot long, weight double")
    weights, heat = np.zeros((len(classes), DIMENSIONS)), 1.0
    for r in trained.collect():
        if r["class"] < 0:
            heat = r["weight"]
        else:
            weights[r["class"], r["slot"]] = r["weight"]
    return Model(classes, idf, weights, heat)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``lang_pred`` (``und`` for text without a letter) and ``score`` of the prediction (then 0).

    The whole text counts, nothing else of the row.  Repeated rows stay, other columns are ignored, an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in in_pieces(batches):
            found = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """:func:`identify` all rows by a model of the rows with a language whose id is not in fold 0; adds ``held_out`` (fold 0).

    A row with a null id is neither learned from nor held out.
    """
    fold = remainder(id_col, folds)
    learned = docs.where((fold != 0) & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(learned, sample)
    out = identify(docs, model, id_col, text_col)
    return out.select(id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
