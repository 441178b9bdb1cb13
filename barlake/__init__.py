"""barlake: daily market-bar analytics as Spark DataFrame transforms.

Every step takes and returns a DataFrame keyed by ``(ticker, date)``; per-ticker
order is always explicit through ``Window.partitionBy("ticker").orderBy("date")``.
"""

from barlake.config import Config, DataConfig, FeatureConfig, MonitorConfig, TrainConfig

__all__ = ["Config", "DataConfig", "FeatureConfig", "MonitorConfig", "TrainConfig"]
