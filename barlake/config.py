"""Job configuration as frozen dataclasses passed to every transform.

The defaults are fixed values that must equal the reference configuration for
the results to agree (window lengths, thresholds, model parameters).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DataConfig:
    # fixed values: cleaning rules
    max_consecutive_fill: int = 2
    max_missing_pct: float = 0.05
    volume_outlier_cap_percentile: float = 99.0
    # preprocess: 20-row rolling mean for volume_normalised
    volume_norm_window: int = 20
    default_start_date: str = "2022-01-01"
    default_end_date: str = "2024-12-31"


@dataclass(frozen=True)
class FeatureConfig:
    # fixed values: indicator windows
    rsi_period: int = 14
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    bollinger_window: int = 20
    bollinger_std: float = 2.0
    volatility_window: int = 20
    volume_ratio_window: int = 20
    lag_periods: tuple[int, ...] = (1, 3, 5)
    sentiment_neutral_fill: float = 0.0


@dataclass(frozen=True)
class TrainConfig:
    # fixed values: split and model parameters
    test_size: float = 0.2
    random_seed: int = 42
    target_column: str = "target_direction"
    rf_n_estimators: int = 200
    rf_max_depth: int = 10
    rf_min_samples_leaf: int = 2
    gbt_n_estimators: int = 200
    gbt_max_depth: int = 6
    gbt_learning_rate: float = 0.1
    gbt_subsample: float = 0.8
    gbt_colsample: float = 0.8
    lr_c: float = 1.0
    lr_max_iter: int = 1000
    iforest_n_estimators: int = 100
    iforest_max_samples: int = 256  # rows per tree; bounds the node table with the number of trees
    iforest_contamination: float = 0.05
    iforest_random_state: int = 42
    fairness_tickers: tuple[str, str] = ("TSLA", "MSFT")
    fairness_min_rows: int = 50
    fairness_gap_limit: float = 0.10


@dataclass(frozen=True)
class MonitorConfig:
    # fixed values: drift and retraining rules
    drift_lookback_days: int = 30
    ks_pvalue_threshold: float = 0.05
    prediction_drift_threshold: float = 0.15
    rolling_accuracy_window: int = 30
    rolling_accuracy_min_periods: int = 10
    min_accuracy_threshold: float = 0.55
    reference_fraction: float = 0.7
    min_log_rows: int = 20
    min_ks_values: int = 10


@dataclass(frozen=True)
class LayoutConfig:
    """How the series windows are laid out (execution only): blocks of ``block_rows``
    consecutive rows per ticker with halos, at every size."""
    block_rows: int = 1 << 16


@dataclass(frozen=True)
class Config:
    data: DataConfig = field(default_factory=DataConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    training: TrainConfig = field(default_factory=TrainConfig)
    monitoring: MonitorConfig = field(default_factory=MonitorConfig)
    layout: LayoutConfig = field(default_factory=LayoutConfig)

DEFAULT = Config()
