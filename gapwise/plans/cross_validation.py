"""Fit, score and evaluate all folds in one job, with the fold as a group key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import fisher_neg_log10, hazard_survival, neg_log10, tail_probability
from ..operators.evaluation import best_f1, by_method, evaluate, fold_summary, score_curve, to_long
from ..operators.statistics import rate_table
from ..operators.tailfit import calibrate
from ..scale import durable, join_on

METHODS = {"tail": "score_tail", "rate": "score_rate", "fisher": "score_fisher"}


def fold_rows(rows: DataFrame, assignment: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows with fold and role; a row appears once per fold that uses its session."""
    a = assignment.select(F.col("session_id").alias(session), "fold", "role")
    return rows.join(a, session)


def score_folds(rows: DataFrame, min_tail: int = 50, user: str = "uid", value: str = "delta_seconds") -> DataFrame:
    """Models from the training rows of each fold, scores for its evaluation rows.

    ``tail``: tail probability of ln(gap) under the fold's model; ``rate``:
    survival under the user's mean rate, the fold's rate for unseen users;
    ``fisher``: both combined.
    """
    rows = rows.where(F.col(value) > 0).withColumn("log_dt", F.ln(value))
    train = rows.where("role = 'train'")
    tail = calibrate(train, ["fold"], "log_dt", min_tail=min_tail).select("fold", "u", "xi", "beta", "p_ref")
    by_user = rate_table(train, ["fold", user], value).select("fold", user, F.col("g").alias("_gu"))
    by_fold = rate_table(train, ["fold"], value).select("fold", F.col("g").alias("_gf"))
    # one row per fold on the broadcast sides
    out = join_on(rows.where("role <> 'train'"), F.broadcast(tail), ["fold"], "inner")
    out = join_on(join_on(out, by_user, ["fold", user]), F.broadcast(by_fold), ["fold"])
    y = F.greatest(F.col("log_dt") - F.col("u"), F.lit(0.0))
    out = out.withColumn("score_tail", neg_log10(tail_probability(y, F.col("xi"), F.col("beta"), F.col("p_ref"))))
    s = hazard_survival(F.coalesce("_gu", "_gf"), 0.0, F.col(value))
    out = out.withColumn("score_rate", neg_log10(s))
    out = out.withColumn("score_fisher", fisher_neg_log10(F.col("score_tail"), F.col("score_rate")))
    return out.drop("u", "xi", "beta", "p_ref", "_gu", "_gf")


def evaluate_folds(scored: DataFrame, label: str = "label") -> DataFrame:
    """Thresholds learned on validation, frozen for test; metrics per fold, role and method."""
    keep = ["fold", "role", "uid", "session_id", "epoch_s", "row_index", label]
    m = by_method(scored, METHODS, keep)
    learned = best_f1(score_curve(m.where("role = 'validation'"), ["fold", "method"], "score", label), ["fold", "method"], "larger")
    m = join_on(m, learned.select("fold", "method", "threshold"), ["fold", "method"])
    m = m.withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))
    return evaluate(m, ["fold", "role", "method"], "score", label, "prediction")


def cross_validate(rows: DataFrame, assignment: DataFrame, min_tail: int = 50) -> tuple[DataFrame, DataFrame]:
    """Metrics per fold and their summary over folds."""
    scored = durable(score_folds(fold_rows(rows, assignment), min_tail))
    metrics = durable(evaluate_folds(scored))
    long = to_long(metrics, ["fold", "role", "method"], ["average_precision", "roc_auc", "f1", "mean_delay_s"])
    return metrics, fold_summary(long, ["role", "method"])
