"""Evaluation against labels.

All ranking metrics collapse rows to distinct scores first and read cumulative
counts from the chunked scan, so one method over all rows is not one task.
``keys`` may hold method, fold, replicate or user.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import hazard_integral
from ..scale import at_least, attach, durable, join_on, last_seen, previous, quantiles, running_sum, scan, total


def _ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def confusion(df: DataFrame, keys: Sequence[str], label: str, pred: str) -> DataFrame:
    """Counts, F1 (0 when undefined) and rates (NULL when undefined)."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    c = df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {
            "f1": F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
            "precision": _ratio(tp, tp + fp),
            "tpr": _ratio(tp, tp + fn),
            "fpr": _ratio(fp, fp + tn),
            "tnr": _ratio(tn, fp + tn),
        }
    )


def boundary_agreement(df: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    """F1, Jaccard and variation of information (bits) of two boundary flags."""
    c = confusion(df, keys, truth, pred).select(*keys, "tp", "fp", "fn", "tn")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def part(joint, a, b):
        return F.when(joint > 0, -(joint / n) * (F.log2(joint / a) + F.log2(joint / b))).otherwise(0.0)

    vi = part(tp, tp + fn, tp + fp) + part(fp, fp + tn, tp + fp) + part(fn, tp + fn, fn + tn) + part(tn, fp + tn, fn + tn)
    empty = (tp + fp + fn) == 0
    return c.withColumns(
        {
            "f1": F.when(empty, 1.0).otherwise(F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))),
            "jaccard": F.when(empty, 1.0).otherwise(_ratio(tp, tp + fp + fn)),
            "variation_bits": F.greatest(vi, F.lit(0.0)),
        }
    )


def score_curve(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """E5: one row per distinct score with rows and positives at or above it."""
    d = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return scan(
        d, keys, ["threshold"],
        {"tp": running_sum("pos"), "fp": running_sum("neg"), "p": total("pos"), "n": total("neg")},
        reverse=True,
    )


def pr_points(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E5: precision and recall at each threshold."""
    return curve.select(
        *keys, "threshold",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("p")).alias("recall"),
    )


def ranking_metrics(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-grouped average precision and area under the ROC curve."""
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    below = F.col("n") - F.col("fp")
    return curve.groupBy(*keys).agg(
        F.max(F.col("p") + F.col("n")).alias("rows"),
        F.max("p").alias("positives"),
        _ratio(F.sum(prec * F.col("pos")), F.max("p")).alias("average_precision"),
        _ratio(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.max("p") * F.max("n")).alias("roc_auc"),
    )


def average_precision_by_row(df: DataFrame, keys: Sequence[str], score: str, label: str, index: str) -> DataFrame:
    """Variant that breaks equal scores by input order."""
    rows = df.select(*keys, (-F.col(score)).alias("_o"), index, (F.col(label) == 1).cast("int").alias("_y"))
    c = scan(rows, keys, ["_o", index], {"_tp": running_sum("_y"), "_n": running_sum(F.lit(1))})
    hit = F.when(F.col("_y") == 1, F.col("_tp") / F.col("_n"))
    return c.groupBy(*keys).agg(_ratio(F.sum(hit), F.sum("_y")).alias("average_precision"))


def best_f1(curve: DataFrame, keys: Sequence[str], ties: str = "smaller") -> DataFrame:
    """Threshold with the best F1.

    ``larger`` and ``smaller`` name the threshold taken among equal F1 values;
    ``smaller`` also tries one above the highest score.  ``extended`` is the
    smaller rule with the candidates 1, 0 and minus infinity, the last one
    reported as NULL.
    """
    keys = list(keys)
    c = curve.select(*keys, "threshold", "tp", "fp", "p")
    if ties == "smaller":
        top = curve.groupBy(*keys).agg((F.max("threshold") + 1).alias("threshold"), F.max("p").alias("p"))
        c = c.unionByName(top.withColumns({"tp": F.lit(0).cast("bigint"), "fp": F.lit(0).cast("bigint")}).select(*c.columns))
    elif ties == "extended":
        extra = F.array(F.lit(1.0), F.lit(0.0), F.lit(float("-inf")))
        more = curve.groupBy(*keys).agg(F.max("p").alias("p"), F.max("n").alias("n"))
        more = more.withColumn("threshold", F.explode(extra))
        marks = curve.select(*keys, "threshold", F.col("pos").alias("a"), F.col("neg").alias("b"), "p", F.lit(0).alias("extra"))
        added = more.select(*keys, "threshold", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "p", F.lit(-1).alias("extra"))
        # extra candidates follow the rows of the same score when walking down
        c = scan(marks.unionByName(added), keys, ["threshold", "extra"], {"tp": running_sum("a"), "fp": running_sum("b")}, reverse=True)
        c = c.select(*keys, "threshold", "tp", "fp", "p")
    f1 = F.coalesce(_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), F.lit(0.0))
    c = c.withColumn("f1", f1)
    side = F.col("threshold") if ties == "larger" else -F.col("threshold")
    take = F.struct("threshold", "f1", "tp", "fp", "p")
    out = c.groupBy(*keys).agg(F.max_by(take, F.struct(F.round("f1", 12), side)).alias("_b"))
    tp, fp = F.col("_b.tp"), F.col("_b.fp")
    t = F.col("_b.threshold")
    return out.select(
        *keys,
        F.when(t != float("-inf"), t).alias("threshold"),
        F.col("_b.f1").alias("f1"),
        F.coalesce(_ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(_ratio(tp, F.col("_b.p")), F.lit(0.0)).alias("recall"),
    )


def segments(
    df: DataFrame, keys: Sequence[str], label: str, pred: str, session: str = "session_id", epoch: str = "epoch_s",
    index: str = "row_index", interleaved: bool = False,
) -> DataFrame:
    """Runs of positive rows in a session and the delay to the first alarm after the start.

    With ``interleaved`` a run also ends where another session's row lies
    between (one time order over all sessions).
    """
    keys = list(keys)
    order = [epoch, index]
    rows = df.withColumn("_alarm", F.when(F.col(pred) == 1, F.col(epoch)))
    if interleaved:
        rows = scan(rows, keys, [epoch, session, index], {"_pl": previous(label), "_ps": previous(session)})
        before = F.when(F.col("_ps") == F.col(session), F.col("_pl"))
    else:
        rows = scan(rows, [*keys, session], order, {"_pl": previous(label)})
        before = F.col("_pl")
    rows = rows.withColumn("_start", (F.col(label) == 1) & (F.coalesce(before, F.lit(0)) != 1))
    rows = scan(rows, [*keys, session], order, {"_next": last_seen("_alarm", inclusive=True)}, reverse=True)
    out = rows.where("_start").select(
        *keys, session, F.col(epoch).alias("start_s"), index,
        at_least(F.col("_next") - F.col(epoch), 0.0).alias("delay_s"),
    )
    return out


def segment_summary(seg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean delay, number of segments, detected ones."""
    return seg.groupBy(*keys).agg(
        F.avg("delay_s").alias("mean_delay_s"), F.count(F.lit(1)).alias("segments"), F.count("delay_s").alias("detected")
    )


def topk_accuracy(df: DataFrame, keys: Sequence[str], hit: str = "topk_hit") -> DataFrame:
    """Share of rows whose target is among the top k."""
    return df.groupBy(*keys).agg(F.avg(F.col(hit).cast("double")).alias("topk_accuracy"))


def gap_log_loss(df: DataFrame, keys: Sequence[str], g: str = "g", w: str = "w", delta: str = "delta", censored: str = "censored") -> DataFrame:
    """Mean negative log likelihood of gaps under hazard exp(g + w t)."""
    ww, d = F.greatest(F.col(w), F.lit(1e-6)), F.greatest(F.col(delta), F.lit(0.0))
    cost = hazard_integral(F.col(g), ww, d)
    loss = F.when(F.col(censored).cast("boolean"), cost).otherwise(cost - (F.col(g) + ww * d))
    return df.where(F.col(delta).isNotNull()).groupBy(*keys).agg(F.avg(loss).alias("neg_log_lik"))


def calibration_curve(df: DataFrame, keys: Sequence[str], prob: str, label: str, bins: int = 15) -> DataFrame:
    """Confidence, accuracy and weight per equal-width bin; the last bin is closed."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prob)))
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    cells = df.where(F.col(prob).isNotNull()).groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy")
    )
    sums = cells.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return attach(cells, sums, list(keys)).withColumn("weight", F.col("n") / F.col("_all")).drop("_all")


def calibration_error(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected calibration error."""
    gap = F.col("weight") * F.abs(F.col("confidence") - F.col("accuracy"))
    return curve.groupBy(*keys).agg(F.sum(gap).alias("ece"))


ALPHAS = [1e-4, 10**-3.5, 1e-3, 10**-2.5, 1e-2] + [0.05 * i for i in range(1, 11)]


def alpha_calibration(df: DataFrame, keys: Sequence[str], p: str, label: str, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Rate of p <= alpha among normal rows at each level, in one pass."""
    levels = sorted({min(0.9, max(1e-6, round(a, 6))) for a in alphas})
    normal = df.where(F.col(label) == 0)
    wide = normal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(p) <= a).alias(f"a{i}") for i, a in enumerate(levels)]
    )
    pairs = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"a{i}").alias("hits")) for i, a in enumerate(levels)])
    out = wide.select(*keys, "_n", F.explode(pairs).alias("_a")).select(*keys, "_n", "_a.*")
    rate = F.col("hits") / F.col("_n")
    return out.select(*keys, "alpha", rate.alias("empirical"), (rate - F.col("alpha")).alias("difference"))


def by_method(df: DataFrame, scores: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per method and input row."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(m) for m, c in scores.items()])
    return wide.unpivot(list(keep), list(scores), "method", "score")


def evaluate(df: DataFrame, keys: Sequence[str], score: str, label: str, pred: str, session: str = "session_id") -> DataFrame:
    """Ranking metrics, confusion and delays per key in one frame."""
    keys = list(keys)
    out = ranking_metrics(score_curve(df, keys, score, label), keys)
    out = attach(out, confusion(df, keys, label, pred).select(*keys, "tp", "fp", "fn", "tn", "f1"), keys)
    return attach(out, segment_summary(segments(df, keys, label, pred, session), keys), keys)


METRICS = ["average_precision", "roc_auc", "f1", "mean_delay_s"]


def macro_by_user(per_user: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean over users of the metrics that are defined for them."""
    return per_user.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("users"))


def reference_fpr(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of flagged rows of a known-normal table."""
    from .scoring import apply_thresholds

    flagged = apply_thresholds(df, thresholds, keys, value)
    return flagged.agg(
        F.count(F.lit(1)).alias("n"), F.sum("anomaly_label").alias("flagged"),
        (F.sum("anomaly_label") / F.count(F.lit(1))).alias("fpr"),
    )


def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value) rows without undefined values."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keys), list(metrics), "metric", "value").where("value IS NOT NULL")


def fold_summary(long: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean, standard deviation and values over folds (a handful per key)."""
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds"),
        F.transform(F.array_sort(F.collect_list(F.struct(fold, "value"))), lambda x: x["value"]).alias("fold_values"),
    )


def aggregate_objective(long: DataFrame, keys: Sequence[str], lam: float = 1.0, trim: float = 0.1) -> DataFrame:
    """Mean, mean minus lambda deviations, worst value and trimmed mean."""
    keys = list(keys)
    rows = scan(long, keys, ["value", "fold"], {"_i": running_sum(F.lit(1)), "_n": total(F.lit(1))})
    k = F.floor(F.col("_n") * F.lit(min(max(trim, 0.0), 0.5)))
    inner = F.when((F.col("_i") > k) & (F.col("_i") <= F.col("_n") - k), F.col("value"))
    return rows.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_valid"),
        (F.avg("value") - lam * F.stddev_pop("value")).alias("mean_minus_std"),
        F.min("value").alias("worst_case"), F.avg(inner).alias("trimmed_mean"),
    )


def _draw(seed: int, what: str, *parts: Column) -> Column:
    """Number in 0 .. 2^32 - 1 from a hash of the parts; the same on every run."""
    text = F.concat_ws(":", F.lit(f"{seed}"), F.lit(what), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bootstrap_rows(df: DataFrame, order: Sequence[str], block: int, replicates: int, seed: int) -> DataFrame:
    """Stationary block bootstrap: blocks of mean length ``block`` with wraparound.

    Every replicate draws as many rows as the table has, which is what the
    method asks for; replicates share nothing and run side by side.  Only blocks
    are ordered and shuffled; their rows appear in the join with the table.
    """
    rows = scan(df, [], order, {"_i": running_sum(F.lit(1))}).withColumn("_i", F.col("_i") - 1)
    rows = rows.drop(*[c for c in rows.columns if c.startswith("_chunk")])
    rows = durable(rows)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    places = attach(rows.select(F.col("_i").alias("pos")), n, [])
    places = places.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # only the first place of each block is kept: one place in ``block``, not one in one, is ordered
    fresh = (F.col("pos") == 0) | (_draw(seed, "cut", F.col("replicate"), F.col("pos")) < F.lit(2**32 // max(block, 1)))
    blocks = durable(places.where(fresh).withColumn("_from", _draw(seed, "start", F.col("replicate"), F.col("pos")) % F.col("_n")))
    blocks = scan(blocks, ["replicate"], ["pos"], {"_next": previous("pos")}, reverse=True)
    length = F.coalesce("_next", "_n") - F.col("pos")
    blocks = blocks.select("replicate", "pos", "_n", "_from", length.alias("_len"))
    # a block runs over rows _from to _to counted on past the end; it meets the rows in short equal strips
    strip = max(block, 1)
    end = F.col("_from") + F.col("_len") - 1
    turns = F.sequence(F.lit(0).cast("bigint"), F.floor(end / F.col("_n")))
    blocks = blocks.select("replicate", "pos", "_n", "_from", end.alias("_to"), F.explode(turns).alias("_turn"))
    low = F.greatest(F.col("_from") - F.col("_turn") * F.col("_n"), F.lit(0))
    high = F.least(F.col("_to") - F.col("_turn") * F.col("_n"), F.col("_n") - 1)
    shift = F.col("pos") - F.col("_from") + F.col("_turn") * F.col("_n")
    blocks = blocks.select("replicate", shift.alias("_shift"), low.alias("_low"), high.alias("_high"))
    strips = F.sequence(F.floor(F.col("_low") / strip), F.floor(F.col("_high") / strip))
    blocks = blocks.withColumn("_strip", F.explode(strips))
    rows = rows.withColumn("_strip", F.floor(F.col("_i") / strip))
    met = blocks.join(rows, (blocks["_strip"] == rows["_strip"]) & F.col("_i").between(F.col("_low"), F.col("_high")))
    kept = [c for c in rows.columns if c not in ("_i", "_strip")]
    return met.select("replicate", (F.col("_i") + F.col("_shift")).alias("pos"), *kept)


def bootstrap_interval(values: DataFrame, keys: Sequence[str], metric: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of a metric over replicates."""
    return quantiles(values.where(F.col(metric).isNotNull()), keys, metric, {"ci_low": low, "ci_high": high}, size="replicates")


def report_rows(summary: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, mean, std, ci_low, ci_high)."""
    out = join_on(summary, intervals, [*keys, "metric"])
    return out.select(*keys, "metric", "mean", "std", "ci_low", "ci_high")


def stored_metrics(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Stored JSON ``{method: {metric: value}}`` as rows."""
    inner = "map<string,map<string,double>>"
    m = df.select(*keys, F.explode(F.from_json(text, inner)).alias("method", "_m"))
    return m.select(*keys, "method", F.explode("_m").alias("metric", "value")).where("value IS NOT NULL")


