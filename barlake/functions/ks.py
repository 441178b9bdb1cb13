"""Two-sample Kolmogorov-Smirnov p-value from (n1, n2, h), two-sided.

h is the statistic in integer units: D = h / (n1 * n2), with
h = max |cum1 * n2 - cum2 * n1| over the pooled values. The exact p-value is
the probability that a uniformly random lattice path from (0, 0) to (n1, n2)
(a random interleaving of the two samples) reaches |i*n2 - j*n1| >= h. Paths that
stay inside are counted column by column: with j the smaller side,
N(i, j) = N(i - 1, j) + N(i, j - 1) is a running sum along i over the allowed
band, so a column is one numpy ``cumsum``. Counts are scaled by the largest one of a column,
whose logarithm is kept. One method at every size: min(n1, n2) running sums over
the band; the recent side has at most 30 values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def _inside_prob(n1: int, n2: int, h: int) -> float:
    """Share of the paths with |i*n2 - j*n1| < h at every step; n1 >= n2."""
    log_scale, first, counts = 0.0, 0, np.zeros(0)
    for j in range(n2 + 1):
        # allowed i: (j*n1 - h) / n2 < i < (j*n1 + h) / n2
        lo, hi = max(0, (j * n1 - h) // n2 + 1), min(n1, -(-(j * n1 + h) // n2) - 1)
        if lo > hi:
            return 0.0
        col = np.zeros(hi - lo + 1)
        if j == 0:
            col[0] = 1.0  # (0, 0); every other point of the column is reached along it
        else:
            a, b = max(lo, first), min(hi, first + len(counts) - 1)
            if a <= b:
                col[a - lo:b - lo + 1] = counts[a - first:b - first + 1]
        counts, first = np.cumsum(col), lo
        top = counts[-1]
        if top == 0.0:
            return 0.0
        counts /= top
        log_scale += math.log(top)
    if first + len(counts) - 1 < n1:
        return 0.0
    log_all = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return float(counts[n1 - first] * math.exp(log_scale - log_all))


def ks_pvalue(n1: int, n2: int, h: int) -> float:
    if n1 <= 0 or n2 <= 0:
        return float("nan")
    if h <= 0:
        return 1.0
    a, b = sorted((int(n1), int(n2)), reverse=True)  # symmetric
    return min(1.0, max(0.0, 1.0 - _inside_prob(a, b, int(h))))


def ks_pvalue_series(n1: pd.Series, n2: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series([ks_pvalue(int(a), int(b), int(c)) for a, b, c in zip(n1, n2, h)], dtype="float64")
