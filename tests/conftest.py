import datetime as dt
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barlake.schemas import BARS  # noqa: E402
from barlake.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="barlake-tests")
    yield s


def weekdays(start: str, n: int) -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def make_bars(spark, rows):
    """rows: list of (ticker, date, open, high, low, close, adj, volume)."""
    return spark.createDataFrame(rows, BARS)


def series_bars(spark, ticker, closes, start="2024-01-01", volume=None, dates=None):
    dates = dates or weekdays(start, len(closes))
    vols = volume or [1000.0 + 10 * i for i in range(len(closes))]
    rows = [(ticker, d, float(c), float(c) + 1, float(c) - 1, float(c), float(c), float(v))
            for d, c, v in zip(dates, closes, vols)]
    return make_bars(spark, rows)
