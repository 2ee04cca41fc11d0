"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets the mean and a shrinkage covariance of the statistics; a document's score is the logistic of the
difference of the two log densities plus the log prior odds.  A log density needs the squared Mahalanobis distance,
computed as |L^-1 (x - mean)|^2 with the Cholesky factor L of the class covariance, factored once at fitting.

The fit needs one row of sums per class (count, sums, sums of products), gathered over all training rows by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import in_pieces
from gapwise.scale import durable

#: fixed: what the statistics count as symbols
SYMBOLS = "#*$%&|<>!{}[]=~^_\\@+"
STATISTICS = ["words", "word_length", "symbols", "upper", "repeated", "distinct", "stops", "digits", "lines", "short"]
#: added to the number of words, so that one repeated word of a short text says little
FEW = 10
#: weight of the pooled diagonal in a class covariance, and the variance added to each standardised statistic
SHRINK, RIDGE = 0.3, 0.05


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text; a text without a word has those of zero words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = sum(map(len, words))
    data = text.encode()
    symbols = chars and (len(data) - len(data.translate(None, SYMBOLS.encode()))) / chars
    letters = len(data.translate(None, b" \n\t\r0123456789.,;:?'\"()-" + SYMBOLS.encode()))
    upper = letters and (len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / letters
    digits = (len(data) - len(data.translate(None, b"0123456789"))) / chars
    repeated = sum(map(str.__eq__, words, words[1:])) / (n + FEW)
    kinds = len(set(words))
    stops = (data.count(b".") + data.count(b",")) / n
    lines = text.count("\n") + 1
    root = np.sqrt
    return [
        float(np.log1p(n)),
        float(np.log(chars / n)),
        float(root(symbols)),
        float(root(min(1.0, upper))),
        float(root(repeated)),
        float(np.log((kinds + FEW) / (n + FEW)) / np.log(n + 2.0)),
        float(root(min(1.0, stops))),
        float(root(digits)),
        float(np.log(n / lines)),
        float(root(sum(len(w) <= 3 for w in words) / n)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Fitted model; ``factors`` are the inverse Cholesky factors of the class covariances."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            logs.append(offset - 0.5 * (((z - mean) @ factor.T) ** 2).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def measure(docs: DataFrame, others: list[str], text_col: str = "text") -> DataFrame:
    """``others`` and ``x``, the statistics of the text, of every row."""
    schema = [*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "__x array<double>"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in in_pieces(batches):
            x = [statistics(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*others, "__x"])

    return docs.select(*others, F.col(text_col).alias("__text")).mapInArrow(run, ", ".join(schema))


def fit(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant | None:
    """Fit on all rows (columns ``x``, ``label``) whose label is 0 or 1; None unless both classes occur."""
    rows = rows.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), "x")
    p = len(STATISTICS)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i, j in pairs],
    )
    by = {r["label"]: r for r in sums.collect()}  # two rows
    if set(by) != {0, 1}:
        return None
    counts = np.array([by[c]["n"] for c in (0, 1)], float)
    first = np.array([[by[c][f"s{i}"] for i in range(p)] for c in (0, 1)]) / counts[:, None]
    second = np.zeros((2, p, p))
    for c in (0, 1):
        for i, j in pairs:
            second[c, i, j] = second[c, j, i] = by[c][f"s{i}_{j}"] / counts[c]
    covs = second - first[:, :, None] * first[:, None, :]
    share = counts / counts.sum()
    centre = share @ first
    spread = np.sqrt(np.maximum(np.einsum("c,cii->i", share, second) - centre**2, 1e-12))
    means = (first - centre) / spread
    covs = covs / spread[:, None] / spread
    pooled = np.einsum("c,cij->ij", share, covs)
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - shrink) * covs[c] + shrink * np.diag(np.diag(pooled)) + ridge * np.eye(p)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(share[c]) - np.log(np.diag(low)).sum())
    return Discriminant(centre, spread, means, np.array(factors), np.array(offsets))


def fit_labelled(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 3, held: int = 1) -> Discriminant | None:
    """Fit on the rows (id and ``__x``) with a label whose id is not in the fold held out; a label that repeats counts as often."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds
    rows = measured.select(F.col(id_col).alias("id"), F.col("__x").alias("x")).where(fold != held)
    labels = labels.select(F.col(id_col).alias("of"), F.col(label_col).alias("label")).where("of IS NOT NULL AND label IS NOT NULL")
    return fit(rows.join(labels, F.col("id") == F.col("of")).select("x", "label"))


def score(measured: DataFrame, model: Discriminant | None, id_col: str = "doc_id") -> DataFrame:
    """Id and ``score`` (0 to 1, higher: label 1 likelier) of measured rows; 0.5 without a model."""
    kind = measured.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = model.scores(x) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y, pa.float64())], ["id", "score"])

    return measured.select(F.col(id_col).alias("id"), "__x").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def learn_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out`` (its id is in the fold that is not learned from), ``score``, ``predicted``.

    Null and blank texts have the statistics of no words and get a score too.  A null id is neither learned from nor held out.
    Repeated rows stay, other columns are ignored, an empty table gives an empty result; without labels of both classes all scores are 0.5.
    """
    measured = durable(measure(docs, [id_col], text_col))
    scored = score(measured, fit_labelled(measured, labels, id_col, label_col, folds, held), id_col)
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    return scored.select(id_col, F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 0.5."""
    model = fit_labelled(measure(docs.join(labels.select(F.col(id_col).alias("__of")).distinct(), F.col(id_col) == F.col("__of"), "left_semi"), [id_col], text_col), labels, id_col, label_col, folds, held)
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in in_pieces(batches):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], float).reshape(b.num_rows, -1)
            yield b.filter(pa.array(model.scores(x) >= 0.5)) if model and b.num_rows else b

    return docs.mapInArrow(run, docs.schema)
