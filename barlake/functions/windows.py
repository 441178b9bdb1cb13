"""Per-ticker window specs and the guarded rolling helper.

``rolling(n)`` in the series math needs n non-null rows; Spark frames return
partial results, so every rolling value is guarded by a count over the same
frame. All specs share ``partitionBy(key).orderBy(order)`` so Catalyst puts
them into one Window node over one exchange.

Spark evaluates every occurrence of a window expression separately (no
de-duplication), so transforms compute each distinct window aggregate once as
a column (``RollingSet``) and derive everything else from those columns.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "ticker"
ORDER = "date"


def _keys(key) -> list:
    return list(key) if isinstance(key, (list, tuple)) else [key]


def series(key: str | list[str] = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*_keys(key)).orderBy(order)


def roll(n: int, key: str = KEY, order: str = ORDER) -> WindowSpec:
    return series(key, order).rowsBetween(-(n - 1), 0)


def whole(key: str | list[str] = KEY) -> WindowSpec:
    return Window.partitionBy(*_keys(key))


def rolling(agg, c: Column | str, n: int, key: str = KEY, order: str = ORDER) -> Column:
    """``agg`` over the last n rows, NULL unless all n rows are non-null (for one-off use)."""
    col = F.col(c) if isinstance(c, str) else c
    w = roll(n, key, order)
    return F.when(F.count(col).over(w) >= n, agg(col).over(w))


def rolling_mean(c, n, key=KEY, order=ORDER) -> Column:
    return rolling(F.avg, c, n, key, order)


def rolling_std(c, n, key=KEY, order=ORDER) -> Column:
    return rolling(F.stddev_samp, c, n, key, order)


class RollingSet:
    """Collects distinct rolling aggregates as named window columns.

    ``get(name, agg, col, n)`` registers ``count`` and ``agg`` of ``col`` over the
    last n rows (once per distinct triple) and returns the guarded Column that
    reads them. ``columns()`` gives the window columns to add in one projection.
    """

    def __init__(self, key: str = KEY, order: str = ORDER):
        self.key, self.order = key, order
        self._cols: dict[str, Column] = {}

    def get(self, name: str, agg: str, c: Column, n: int) -> Column:
        w = roll(n, self.key, self.order)
        cnt, val = f"_w_{name}_{n}_n", f"_w_{name}_{n}_{agg}"
        if cnt not in self._cols:
            self._cols[cnt] = F.count(c).over(w)
        if val not in self._cols:
            fn = {"avg": F.avg, "std": F.stddev_samp, "sum": F.sum}[agg]
            self._cols[val] = fn(c).over(w)
        return F.when(F.col(cnt) >= n, F.col(val))

    def columns(self) -> dict[str, Column]:
        return dict(self._cols)

    def names(self) -> list[str]:
        return list(self._cols)
