"""NaN / NULL / Inf handling under ANSI mode, in one place.

Spark 4 raises on ``x / 0`` and returns NULL for ``ln(0)``; the series math
we reproduce yields +/-Inf there (kept by the missing-value drop) and NaN for
``0 / 0`` (dropped). Every division and log in the library goes through these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def pos_inf() -> Column:
    return F.lit(float("inf"))


def neg_inf() -> Column:
    return F.lit(float("-inf"))


def nan_to_null(c: Column) -> Column:
    """Spark orders NaN above every number; the library treats it as missing."""
    return F.nanvl(c, F.lit(None).cast("double"))


def fdiv(num: Column, den: Column) -> Column:
    """Float division: x/0 -> +/-Inf by the sign of x, 0/0 -> NULL, NULL stays NULL."""
    return (
        F.when(den.isNull() | num.isNull(), F.lit(None).cast("double"))
        .when(den == 0,
              F.when(num > 0, pos_inf()).when(num < 0, neg_inf()).otherwise(F.lit(None).cast("double")))
        .otherwise(num / den)
    )


def flog(x: Column) -> Column:
    """Natural log (X1): ln(0) = -Inf, ln(+Inf) = +Inf, ln(negative) = NULL."""
    return (
        F.when(x == 0, neg_inf())
        .when(x == float("inf"), pos_inf())
        .when(x > 0, F.ln(x))
        .otherwise(F.lit(None).cast("double"))
    )


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """Ratio for metrics: ``zero_division`` -> default."""
    return F.coalesce(F.try_divide(num, den), F.lit(default))
