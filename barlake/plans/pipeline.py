"""Batch build: bars -> validate -> clean -> preprocess -> features (one lazy plan).

One layout at every size: each ticker's rows are cut into blocks of
``cfg.layout.block_rows`` consecutive rows with halos (``plans.blocked``), so a
ticker with a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from barlake.config import Config, DEFAULT
from barlake.plans.blocked import clean_blocked_with_report, feature_table_blocked, preprocessed_blocked


def cleaned_with_report(bars: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    cleaned, report = clean_blocked_with_report(bars, cfg, cfg.layout.block_rows)
    return cleaned.drop("_blk", "_p"), report


def cleaned_bars(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return cleaned_with_report(bars, cfg)[0]


def preprocessed_bars(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return preprocessed_blocked(bars, cfg, cfg.layout.block_rows).drop("_blk", "_i")


def feature_table(bars: DataFrame, cfg: Config = DEFAULT, sentiment: DataFrame | None = None) -> DataFrame:
    return feature_table_blocked(bars, cfg, sentiment, cfg.layout.block_rows)


def clean_report(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return cleaned_with_report(bars, cfg)[1]
