"""Tail probabilities and thresholds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scale import at_least, at_most


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def tail_survival(excess, xi, beta) -> Column:
    """Survival of an excess over the threshold; exponential limit near xi = 0."""
    y, xi, b = num(excess), num(xi), at_least(num(beta), 1e-12)
    inside = 1 + xi * y / b
    return (
        F.when(y <= 0, 1.0)
        .when(F.abs(xi) < 1e-12, F.exp(-y / b))
        .when(inside <= 0, 0.0)
        .otherwise(F.pow(inside, -1 / F.when(xi != 0, xi)))
    )


def tail_probability(excess, xi, beta, p_ref) -> Column:
    p = at_least(num(p_ref), 0.0)
    return F.when(num(excess) <= 0, p).otherwise(p * tail_survival(excess, xi, beta))


def tail_threshold(u, xi, beta, p_ref, q, floor_q: float = 1e-12, limit: float = 1e-12) -> Column:
    """Level exceeded with probability q, given rate p_ref above u."""
    u, xi, b = num(u), num(xi), at_least(num(beta), 1e-12)
    ratio = at_least(num(p_ref) / at_least(num(q), floor_q), 1e-12)
    return F.when(F.abs(xi) < limit, u + b * F.ln(ratio)).otherwise(
        u + b / F.when(xi != 0, xi) * (F.pow(ratio, xi) - 1)
    )


def adaptive_level(u, xi, beta, p_ref, q_star) -> Column:
    """C4: threshold not below u and not beyond the end point of a bounded tail."""
    u, xi, b = num(u), num(xi), num(beta)
    level = at_least(tail_threshold(u, xi, beta, p_ref, q_star), u)
    return F.when(xi < 0, at_most(level, u - b / F.when(xi != 0, xi))).otherwise(level)


def neg_log10(p, floor: float = 1e-300) -> Column:
    return -F.log10(at_least(num(p), floor))


def chi2_survival_even(x, half_df: int) -> Column:
    """Survival of chi-square with 2*half_df degrees of freedom (closed form)."""
    h = at_least(num(x), 0.0) / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, half_df):
        term = term * h / i
        total = total + term
    return F.exp(-h) * total


def clip_p(p, eps: float = 1e-12) -> Column:
    return at_least(at_most(num(p), 1 - eps), eps)


def fisher_statistic(*ps) -> Column:
    total = F.lit(0.0)
    for p in ps:
        total = total + F.ln(clip_p(p))
    return -2 * total


def fisher_neg_log10(a, b) -> Column:
    """Two -log10(p) scores combined with equal weight (4 degrees of freedom)."""
    pa, pb = (at_least(at_most(F.pow(F.lit(10.0), -num(s)), 1.0), 1e-300) for s in (a, b))
    p = chi2_survival_even(-2 * (F.ln(pa) + F.ln(pb)), 2)
    return -F.log10(at_least(at_most(p, 1.0), 1e-300))


# hazard exp(g + w t): integrated hazard, survival, quantile time


def hazard_integral(g, w, delta) -> Column:
    d, w = at_least(num(delta), 0.0), at_least(num(w), 0.0)
    rate = F.exp(num(g))
    return F.when(w <= 1e-6, rate * d).otherwise(rate * F.expm1(w * d) / F.when(w > 0, w))


def hazard_survival(g, w, delta) -> Column:
    return F.exp(-hazard_integral(g, w, delta))


def hazard_quantile_time(g, w, q: float) -> Column:
    """Time at which survival falls to q; NULL when it never does."""
    w = at_least(num(w), 0.0)
    need = F.lit(q)
    gain = -w * F.ln(need) * F.exp(-num(g))
    return F.when(w <= 1e-6, -F.ln(need) / F.exp(num(g))).when(gain > -1, F.log1p(gain) / F.when(w > 0, w))
