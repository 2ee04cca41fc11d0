"""Next-event pairs and scores without a network."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_survival_even, clip_p, neg_log10
from ..scale import attach, durable, join_on, previous, scan
from .audits import smooth_scores


def next_event_pairs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], event: str = "event", epoch: str = "epoch_s",
    numeric: Sequence[str] = (), bos: bool = False,
) -> DataFrame:
    """Event, following event, gap and numbers of the following row.

    Keys with one event have no pair.  With ``bos`` the first event is also the
    target of a start token.
    """
    carried = {"context": previous(event), "_pt": previous(epoch)}
    rows = scan(df, keys, order, carried).withColumn("target", F.col(event))
    rows = rows.withColumn("delta", F.col(epoch) - F.col("_pt"))
    if bos:
        rows = rows.withColumn("context", F.coalesce("context", F.lit("<bos>")))
    rows = rows.where("context IS NOT NULL")
    rows = rows.withColumn("censored", F.coalesce(F.col("delta") < 0, F.lit(False)))
    return rows.select(*keys, *[c for c in order if c not in keys], "context", "target", "delta", "censored", *numeric)


def topk_table(trans: DataFrame, k: int) -> DataFrame:
    """C11: rank of each target in its context and the mass of the k most likely.

    A context has at most one row per token of the vocabulary.
    """
    w = Window.partitionBy("context").orderBy(F.desc("p"), "target")
    r = trans.withColumn("rank", F.row_number().over(w))
    mass = F.sum(F.when(F.col("rank") <= k, F.col("p"))).over(Window.partitionBy("context"))
    return r.withColumn("topk_mass", F.least(F.lit(1.0), mass))


def surprise(pairs: DataFrame, trans: DataFrame, k: int = 3) -> DataFrame:
    """C11: mass of the top k, its complement, and whether and where the target is among them."""
    t = topk_table(trans, k)
    masses = t.groupBy("context").agg(F.max("topk_mass").alias("topk_mass"))
    out = join_on(join_on(pairs, masses, ["context"]), t.select("context", "target", "p", "rank"), ["context", "target"])
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return out.withColumns(
        {
            "p_ev": 1 - F.col("topk_mass"),
            "topk_hit": hit.cast("int"),
            "topk_rank": F.when(hit, F.col("rank")),
        }
    ).drop("rank")


def combine_event_time(mass: Column, p_time: Column, censored: Column) -> dict[str, Column]:
    """Fisher combination of the event and, unless censored, the time component."""
    ev = -2 * F.ln(clip_p(mass))
    stat = F.when(censored, ev).otherwise(ev - 2 * F.ln(clip_p(1 - p_time)))
    p = F.when(censored, chi2_survival_even(stat, 1)).otherwise(chi2_survival_even(stat, 2))
    return {"fisher_statistic": stat, "combined_p": p, "neglog10_p": neg_log10(p)}


def sequence_score(pairs: DataFrame, trans: DataFrame, keys: Sequence[str], order: Sequence[str], window: int = 5) -> DataFrame:
    """-ln p(target) plus distance of the gap from the context's mean gap, smoothed."""
    expected = pairs.groupBy("context").agg(F.avg("delta").alias("_mean"))
    out = join_on(join_on(pairs, trans.select("context", "target", "p"), ["context", "target"]), expected, ["context"])
    raw = -F.ln(F.greatest(F.coalesce("p", F.lit(1e-12)), F.lit(1e-12))) + F.abs(F.col("delta") - F.col("_mean"))
    return smooth_scores(out.withColumn("score", raw), keys, "score", window, order[0], order[1]).drop("_mean")


# calibration of transition probabilities (E15) --------------------------------


def _ece_by_temperature(trans: DataFrame, temps: Sequence[float], bins: int) -> DataFrame:
    """Expected calibration error of the most likely token for each temperature.

    The table has one row per context and token; temperatures multiply it.
    """
    grid = trans.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in temps])))
    w = Window.partitionBy("t", "context")
    scaled = F.exp(F.ln("p") / F.col("t"))
    grid = grid.withColumn("q", scaled / F.sum(scaled).over(w))
    best = grid.groupBy("t", "context").agg(
        F.max("q").alias("confidence"),
        F.max_by("n", F.struct("q", "n")).alias("hits"),
        F.sum("n").alias("rows"),
    )
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    cells = best.groupBy("t", b.alias("b")).agg(
        F.sum("rows").alias("rows"), F.sum("hits").alias("hits"), F.sum(F.col("confidence") * F.col("rows")).alias("conf")
    )
    gap = F.abs(F.col("hits") / F.col("rows") - F.col("conf") / F.col("rows")) * F.col("rows")
    return cells.groupBy("t").agg((F.sum(gap) / F.sum("rows")).alias("ece"))


def calibrate_temperature(trans: DataFrame, bins: int = 15) -> DataFrame:
    """Temperature with the least calibration error: a log grid, then three finer ones."""
    trans = durable(trans.select("context", "target", "n", "p"))
    low, high = math.log(0.05), math.log(10.0)
    temps = [1.0] + [math.exp(low + (high - low) * i / 49) for i in range(50)]
    best = None
    span = 0.25
    for _ in range(4):
        rows = _ece_by_temperature(trans, sorted(set(temps)), bins).collect()  # one row per temperature
        pool = [(round(r["ece"], 6), r["t"], r["ece"]) for r in rows] + ([best] if best else [])
        best = min(pool)
        mid = math.log(best[1])
        a, b = max(low, mid - span), min(high, mid + span)
        temps = [math.exp(a + (b - a) * i / 24) for i in range(25)]
        span /= 2
    before = _ece_by_temperature(trans, [1.0], bins).first()["ece"]
    return trans.sparkSession.createDataFrame(
        [(float(best[1]), float(best[2]), float(before))], "temperature double, ece double, ece_before double"
    )


def coverage_curve(trans: DataFrame, max_k: int) -> DataFrame:
    """Share of targets among the k most likely tokens, and the smallest sufficient k."""
    ranks = topk_table(trans, 1).groupBy("rank").agg(F.sum("n").alias("n"))
    ks = ranks.select("rank", "n").where(F.col("rank") <= max_k)
    total = ranks.agg(F.sum("n").alias("_all"))
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most max_k rows
    curve = attach(ks, total, []).select(F.col("rank").alias("k"), (F.sum("n").over(w) / F.col("_all")).alias("coverage"))
    top = curve.agg(F.max("coverage").alias("_top"))
    out = attach(curve, top, [])
    enough = F.col("coverage") >= 0.99 * F.col("_top")
    pick = F.min(F.when(enough, F.col("k"))).over(Window.partitionBy())
    return out.withColumn("selected", F.col("k") == pick).drop("_top")
