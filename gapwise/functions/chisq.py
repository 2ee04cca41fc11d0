"""Chi-square survival for a non-integer number of degrees of freedom (weighted C13)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scale import at_least, at_most


def upper_gamma(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma: power series below a + 1, continued fraction above."""
    x = np.maximum(np.asarray(x, dtype=float), 0.0)
    scale = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(a))
    term = np.full_like(x, 1.0 / a)
    series = term.copy()
    for k in range(1, 500):
        term = term * x / (a + k)
        series = series + term
        if np.all(term[x < a + 1] < 1e-16):
            break
    low = 1.0 - scale * series
    big = np.maximum(x, a + 1)
    frac = np.zeros_like(x)
    for k in range(200, 0, -1):
        frac = k * (a - k) / (big + 2 * k + 1 - a + frac)
    high = scale / (big + 1 - a + frac)
    return np.where(x < a + 1, low, high)


def chi2_survival(stat: Column, df: float) -> Column:
    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return pd.Series(upper_gamma(df / 2.0, s.to_numpy(float) / 2.0))

    return tail(stat)


def weighted_fisher_neg_log10(a: Column, b: Column, wa: float, wb: float) -> Column:
    pa, pb = (at_least(at_most(F.pow(F.lit(10.0), -s), 1.0), 1e-300) for s in (a, b))
    stat = -2 * (wa * F.ln(pa) + wb * F.ln(pb))
    p = chi2_survival(stat, 2.0 * (wa + wb))
    return -F.log10(at_least(at_most(p, 1.0), 1e-300))
