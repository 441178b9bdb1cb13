"""Business-day calendar (Mon-Fri, no holidays) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5  # weekday(): 0 = Monday


def weekdays_between(start: Column, end: Column) -> Column:
    """Number of Mon-Fri days in [start, end], closed form (no calendar table).

    Whole weeks give 5 each; the remaining r < 7 days start at weekday s, so
    they cover cycle positions [s, s + r), of which positions 0-4 and 7-11 are
    weekdays.
    """
    days = F.datediff(end, start) + 1
    r = days % 7
    s = F.weekday(start)
    e = s + r
    extra = F.greatest(F.lit(0), F.least(e, F.lit(5)) - s) + F.greatest(
        F.lit(0), F.least(e, F.lit(12)) - F.greatest(s, F.lit(7))
    )
    return F.when(end < start, F.lit(0)).otherwise((F.floor(days / 7) * 5 + extra).cast("long"))


def weekday_sequence(start: Column, end: Column) -> Column:
    """Array of the weekdays in [start, end] (empty when end < start)."""
    return F.when(end < start, F.array().cast("array<date>")).otherwise(
        F.filter(F.sequence(start, end, F.expr("interval 1 day")), lambda d: F.weekday(d) < 5)
    )
