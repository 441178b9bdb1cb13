"""Output column specs shared by a registered query and its SQL twin.

A spec is a list of ``(name, kind)``; kinds fix the type and the rounding (X3)
so the Spark result and the DuckDB result hash the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = {"double": 6, "ema": 4, "d2": 2, "d4": 4}
SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "bool": "BOOLEAN"}


def spark_project(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    cols = []
    for name, kind in spec:
        c = F.col(f"`{name}`")
        if kind in PLACES:
            c = F.round(c.cast("double"), PLACES[kind])
        elif kind == "long":
            c = c.cast("long")
        elif kind == "int":
            c = c.cast("int")
        elif kind == "string":
            c = c.cast("string")
        elif kind == "date":
            c = c.cast("date")
        elif kind == "bool":
            c = c.cast("boolean")
        cols.append(c.alias(name))
    return df.select(*cols)


def sql_project(inner: str, spec: list[tuple[str, str]]) -> str:
    cols = []
    for name, kind in spec:
        q = f'"{name}"'
        if kind in PLACES:
            cols.append(f"round(CAST({q} AS DOUBLE), {PLACES[kind]}) AS {q}")
        else:
            cols.append(f"CAST({q} AS {SQL_TYPES[kind]}) AS {q}")
    return f"SELECT {', '.join(cols)}\nFROM ({inner}\n) q_out"


BARS_SPEC = [("ticker", "string"), ("date", "date"), ("Open", "double"), ("High", "double"),
             ("Low", "double"), ("Close", "double"), ("Adj Close", "double"), ("Volume", "double")]

PRE_SPEC = BARS_SPEC + [("log_return", "double"), ("volume_normalised", "double")]


def features_spec(cfg) -> list[tuple[str, str]]:
    f = cfg.features
    return PRE_SPEC + [
        (f"rsi_{f.rsi_period}", "double"), ("macd", "ema"), ("macd_signal", "ema"),
        ("macd_histogram", "ema"), ("bb_upper", "double"), ("bb_middle", "double"),
        ("bb_lower", "double"), ("bb_position", "double"),
        (f"volatility_{f.volatility_window}d", "double"), ("volume_ratio", "double"),
        ("sentiment_score", "double"),
    ] + [(f"return_lag_{k}d", "double") for k in f.lag_periods] + [
        ("target_direction", "int"), ("price_change_pct", "double"),
    ]
