"""Classification metrics at table scale.

Confusion counts, accuracy, precision, recall and F1 are one aggregate per
group (partial aggregation map-side). ROC-AUC is the rank-sum statistic with
ties at half weight, computed exactly without an un-partitioned window from
the bucketed cumulative counts of ``operators.ecdf`` (a hot score value is
one row; no group is sorted whole in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.numeric import safe_ratio
from barlake.operators.ecdf import cumulative_counts



def confusion_metrics(scored: DataFrame, group_cols: list[str] | None = None,
                      label: str = "label", pred: str = "prediction") -> DataFrame:
    """tn/fp/fn/tp and accuracy/precision/recall/F1 (zero_division = 0) per group."""
    group_cols = group_cols or []
    y, p = F.col(label), F.col(pred)
    agg = scored.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    return with_rates(agg)


def with_rates(agg: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.withColumns({
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
    })


def roc_auc(scored: DataFrame, group_cols: list[str] | None = None,
            label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC-AUC per group: P(score+ > score-) + 0.5 * P(score+ = score-).

    From cumulative counts per distinct score: each positive at score s pairs
    with the negatives strictly below s (cum_neg - n_neg) and half of those at s.
    """
    group_cols = group_cols or []
    flags = scored.select(*group_cols, F.col(score).cast("double").alias("_s"),
                          (F.col(label) == 1).alias("pos"), (F.col(label) == 0).alias("neg"))
    if not group_cols:
        flags = flags.withColumn("_all", F.lit(0))
    keys = group_cols or ["_all"]
    cum = cumulative_counts(flags, keys, "_s", ["pos", "neg"])
    # twice the pairs, as exact integers: the sum doesn't depend on the order
    wide = lambda c: c.cast("decimal(19,0)")
    twice = wide(F.col("n_pos")) * wide(2 * F.col("cum_neg") - F.col("n_neg"))
    out = cum.groupBy(*keys).agg((F.sum(twice.cast("decimal(38,0)")).cast("double") / 2).alias("_pairs"), F.first("tot_pos").alias("_P"),
                                 F.first("tot_neg").alias("_N"))
    return out.select(*group_cols, F.try_divide(F.col("_pairs"), F.col("_P").cast("double") * F.col("_N").cast("double"))
                      .alias("roc_auc"))


def baseline_always_up(labels: DataFrame, group_cols: list[str] | None = None,
                       label: str = "label") -> DataFrame:
    """Naive always-UP baseline in closed form of p = mean(label)."""
    group_cols = group_cols or []
    agg = labels.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("p"))
    p = F.col("p")
    return agg.select(
        *group_cols, "n",
        p.alias("accuracy"), p.alias("precision"),
        F.when(p > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("recall"),
        safe_ratio(2 * p, 1 + p).alias("f1"),
    )


def class_balance(df: DataFrame, split_col: str = "split", label: str = "target_direction") -> DataFrame:
    """Rows and share of label 1 per split (G9) and class counts."""
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("n_up"),
        F.avg(F.col(label).cast("double")).alias("up_share"),
    )


def fairness(scored: DataFrame, pair: tuple[str, str], min_rows: int = 50, gap_limit: float = 0.10,
             key: str = "ticker", label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per-group accuracy / F1 / samples for the two named groups with >= min_rows
    rows (G14, F13 subset, F12 guard), plus the accuracy gap and the warning flag
    (G15); the two groups end up side by side through conditional aggregates (J5)."""
    m = confusion_metrics(scored.where(F.col(key).isin(list(pair))), [key], label, pred)
    m = m.where(F.col("n") >= min_rows)
    a, b = pair
    wide = m.agg(*[
        F.max(F.when(F.col(key) == t, F.col(c))).alias(f"{c}_{t}")
        for t in pair for c in ("accuracy", "f1", "n")
    ])
    gap = F.abs(F.col(f"accuracy_{a}") - F.col(f"accuracy_{b}"))
    return wide.withColumns({"accuracy_gap": gap, "gap_warning": gap > gap_limit})


def best_by_f1(metrics: DataFrame, name_col: str = "model", order_col: str = "ordinal") -> DataFrame:
    """Best model by F1, the first in list order wins a tie."""
    return metrics.agg(F.max_by(F.col(name_col), F.struct(F.col("f1"), -F.col(order_col))).alias("best_model"))


def beats_baseline(metrics: DataFrame, baseline_f1: Column) -> DataFrame:
    """Flag per model: F1 above the naive baseline's F1 (G17); baseline is a scalar."""
    return metrics.withColumn("beats_baseline", F.col("f1") > baseline_f1)
