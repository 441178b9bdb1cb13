"""Blocked series layout: a hot ticker's series split over many tasks.

One ticker may hold a large share of all rows (intraday bars, years of ticks), so
this layout cuts every ticker into
blocks of B consecutive rows and evaluates the windows of the operators inside
``partitionBy(ticker, block)``; every block also holds a *halo*, copies of the
rows before it that its look-backs reach. Results equal windows over whole
tickers: rolling frames and lags see the same rows, and the EMA recursion,
restarted at the halo start, has decayed below e^-40 of its state by the
first own row.

Row positions stay dense, so block membership and the EMA exponents are
exact:
* cleaning works on calendar positions, i.e. weekday ordinals from each
  ticker's first bar in closed form. The dense calendar skeleton is generated
  per block from the per-ticker span, with no ``lead`` over the series, and
  merged with the bars by one aggregate;
* after each missing-value drop the surviving rows are re-indexed: a row
  count per block (small table), prefix sums over blocks, plus a row number
  inside the block;
* per-ticker scalars are aggregates: the missing share, and the volume cap as
  an exact quantile over order buckets (``operators.ecdf.exact_quantile``).

Filled rows and preprocessed rows are read several times (share, cap, counts, row numbers), so
each is one table in the shared folder: nothing stays cached, a lost executor repeats no
earlier stage, and later plans start from a scan. Exchanges: one per layout (clean,
preprocess, features) plus the joins of per-ticker and per-block tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.config import DEFAULT, Config
from barlake.functions.calendar import weekdays_between
from barlake.operators.cleaning import forward_fill, preprocess
from barlake.operators.ecdf import exact_quantile
from barlake.operators.indicators import add_sentiment, display_indicators, engineer_features
from barlake.schemas import VALUE_COLS
from barlake.session import staged

KEY = "ticker"
COPY_T = "array<struct<b:bigint,own:boolean>>"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def month_number(d: Column) -> Column:
    """Months since year 0: the coarse order key rows are numbered in first."""
    return F.year(d) * 12 + F.month(d)


def first_weekday(d: Column) -> Column:
    return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))


def position_date(first_wd: Column, pos: Column) -> Column:
    """Date of the pos-th weekday (0-based) counted from a weekday ``first_wd``."""
    s, r = F.weekday(first_wd), pos % 5
    days = F.floor(pos / 5) * 7 + r + F.when(s + r >= 5, 2).otherwise(0)
    return F.date_add(first_wd, days.cast("int"))


def feature_halo(cfg: Config = DEFAULT) -> int:
    """Rows before a block that its feature windows reach (EMA decay chain included)."""
    f = cfg.features

    def decay(span: int) -> int:
        return math.ceil(40.0 / -math.log(1.0 - 2.0 / (span + 1.0)))

    windows = max(f.rsi_period + 1, f.bollinger_window, f.volatility_window, f.volume_ratio_window,
                  max(f.lag_periods) + 1)
    return max(decay(f.macd_fast), decay(f.macd_slow)) + decay(f.macd_signal) + windows + 2


def copies(i: Column, block_rows: int, back: int, fwd: int = 0) -> Column:
    """Own block of row i plus every later block whose ``back`` halo reaches it,
    plus the previous block when i is among the first ``fwd`` rows of its block."""
    own = F.floor(i / block_rows)
    last = F.floor((i + back) / block_rows)
    halo = F.when(last > own, F.sequence(own + 1, last)).otherwise(F.array().cast("array<bigint>"))
    arr = F.concat(F.array(F.struct(own.alias("b"), F.lit(True).alias("own"))),
                   F.transform(halo, lambda b: F.struct(b.alias("b"), F.lit(False).alias("own"))))
    if fwd:
        prev = F.when((i % block_rows < fwd) & (own > 0),
                      F.array(F.struct((own - 1).alias("b"), F.lit(False).alias("own")))).otherwise(
            F.array().cast(COPY_T))
        arr = F.concat(arr, prev)
    return arr


def lay_out(df: DataFrame, index: str, block_rows: int, back: int, fwd: int = 0) -> DataFrame:
    """Rows exploded into their own block and halo copies, hash-partitioned by (ticker, block)."""
    keep = [c for c in df.columns if c not in ("_blk", "_own")]
    return (df.select(*[_c(c) for c in keep], F.explode(copies(F.col(index), block_rows, back, fwd)).alias("_cp"))
            .select(*[_c(c) for c in keep], F.col("_cp.b").alias("_blk"), F.col("_cp.own").alias("_own"))
            .repartition(KEY, "_blk"))


def dense_index(df: DataFrame, block_col: str, order: str, out: str, total: str | None = None) -> DataFrame:
    """0-based dense row index per ticker for rows laid out in ordered blocks
    (and, with ``total``, the ticker's row count from the same small table)."""
    counts = df.groupBy(KEY, block_col).agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(KEY).orderBy(block_col).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_cnt").over(Window.partitionBy(KEY)).alias(total)] if total else []
    offsets = counts.select(KEY, block_col, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"), *extra)
    rn = F.row_number().over(Window.partitionBy(KEY, block_col).orderBy(order))
    return df.join(offsets, [KEY, block_col]).withColumn(out, F.col("_off") + rn - 1).drop("_off")


def clean_blocked(bars: DataFrame, cfg: Config = DEFAULT, block_rows: int = 1 << 18) -> DataFrame:
    """Calendar densify + fill + sparse drop + volume cap on calendar positions.

    Returns cleaned rows with ``_blk`` (the position block) and ``_p`` (position)."""
    return clean_blocked_with_report(bars, cfg, block_rows)[0]


def clean_blocked_with_report(bars: DataFrame, cfg: Config = DEFAULT,
                              block_rows: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """``clean_blocked`` plus the clean report of ``operators.cleaning.clean_with_report``
    (missing share, kept flag, volume cap, capped and cleaned row counts), all from
    per-ticker aggregates."""
    d = cfg.data
    values = [c for c in VALUE_COLS if c in bars.columns]
    B, H = block_rows, d.max_consecutive_fill
    span = (bars.groupBy(KEY).agg(F.min("date").alias("_a"), F.max("date").alias("_z"))
            .select(KEY, first_weekday(F.col("_a")).alias("_f"),
                    weekdays_between(F.col("_a"), F.col("_z")).alias("_n"))
            .where(F.col("_n") > 0))
    blocks = span.select(KEY, "_f", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / B)))
                         .alias("_blk"))
    lo = F.greatest(F.lit(0), F.col("_blk") * B - H)
    hi = F.least(F.col("_n") - 1, F.col("_blk") * B + B - 1)
    skel = blocks.select(KEY, "_f", "_blk", F.explode(F.sequence(lo, hi)).alias("_p")).select(
        KEY, "_blk", "_p", "_f", (F.col("_p") >= F.col("_blk") * B).alias("_own"),
        *[F.lit(None).cast("double").alias(c) for c in values])
    placed = (bars.where(F.weekday("date") < 5).join(span.select(KEY, "_f"), KEY)
              .withColumn("_p", weekdays_between(F.col("_f"), F.col("date")) - 1))
    bar_rows = placed.select(KEY, "_p", *[_c(c) for c in values],
                             F.explode(copies(F.col("_p"), B, H)).alias("_cp")).select(
        KEY, F.col("_cp.b").alias("_blk"), "_p", F.lit(None).cast("date").alias("_f"),
        F.col("_cp.own").alias("_own"), *[_c(c) for c in values])
    merged = (skel.unionByName(bar_rows).repartition(KEY, "_blk")
              .groupBy(KEY, "_blk", "_p")
              .agg(F.max("_f").alias("_f"), F.max("_own").alias("_own"), *[F.max(_c(c)).alias(c) for c in values]))
    filled = forward_fill(merged, d.max_consecutive_fill, values, key=[KEY, "_blk"], order="_p")
    # share, cap, counts and the cleaned rows all read the filled rows: fill once
    own = staged(filled.where(F.col("_own")).drop("_own"), "filled")
    n_null = sum(F.when(_c(c).isNull(), 1).otherwise(0) for c in values)
    share = own.groupBy(KEY).agg(F.avg(n_null / F.lit(float(len(values)))).alias("_mp"))
    kept = (own.join(share.where(F.col("_mp") <= F.lit(d.max_missing_pct)).select(KEY), KEY, "left_semi")
            .na.drop(how="any", subset=values))
    # exact percentile without merging a ticker's volumes in one task
    caps = exact_quantile(kept, [KEY], "Volume", d.volume_outlier_cap_percentile / 100.0, out="_cap")
    cleaned = kept.join(caps, KEY).select(
        KEY, "_blk", "_p", position_date(F.col("_f"), F.col("_p")).alias("date"),
        *[(F.least(_c(c), F.col("_cap")) if c == "Volume" else _c(c)).alias(c) for c in values])
    counts = kept.join(caps, KEY).groupBy(KEY).agg(
        F.first("_cap").alias("volume_cap"),
        F.count_if(_c("Volume") > F.col("_cap")).alias("n_capped"),
        F.count(F.lit(1)).alias("cleaned_rows"))
    report = share.join(counts, KEY, "left").select(
        KEY, F.col("_mp").alias("missing_pct"), (F.col("_mp") <= F.lit(d.max_missing_pct)).alias("kept"),
        "volume_cap", F.coalesce("n_capped", F.lit(0)).cast("long").alias("n_capped"),
        F.coalesce("cleaned_rows", F.lit(0)).cast("long").alias("cleaned_rows"))
    return cleaned, report


def preprocessed_blocked(bars: DataFrame, cfg: Config = DEFAULT, block_rows: int = 1 << 18) -> DataFrame:
    """Cleaned + preprocessed rows (log return, normalised volume), warm-up dropped.
    Keeps ``_blk`` / ``_i`` (the layout of the preprocess windows)."""
    cleaned = dense_index(clean_blocked(bars, cfg, block_rows), "_blk", "_p", "_i").drop("_p")
    lay2 = lay_out(cleaned, "_i", block_rows, back=cfg.data.volume_norm_window)
    pre = preprocess(lay2, cfg.data, key=[KEY, "_blk"], order="_i", drop=False).where(F.col("_own"))
    return pre.na.drop(how="any", subset=[c for c in pre.columns if not c.startswith("_")]).drop("_own")


def features_from_preprocessed_blocked(pre: DataFrame, cfg: Config = DEFAULT, sentiment: DataFrame | None = None,
                                       block_rows: int = 1 << 18) -> DataFrame:
    """Feature windows in row blocks over a preprocessed table.

    With ``_blk`` / ``_i`` from ``preprocessed_blocked`` the rows are renumbered
    from those blocks; a table read back from storage is numbered by month of date.
    """
    if "_blk" in pre.columns and "_i" in pre.columns:
        idx = dense_index(pre, "_blk", "_i", "_j").drop("_i")
    else:
        dealt = pre.withColumn("_bk", month_number(F.col("date"))).repartition(KEY, "_bk")
        idx = dense_index(dealt, "_bk", "date", "_j").drop("_bk")
    lay3 = lay_out(idx, "_j", block_rows, back=feature_halo(cfg), fwd=1)
    feats = engineer_features(lay3, cfg.features, None, key=[KEY, "_blk"], order="_j", index="_j")
    out = feats.where(F.col("_own")).drop("_blk", "_own", "_j", "sentiment_score")
    out = add_sentiment(out, sentiment, cfg.features.sentiment_neutral_fill)
    names = [c for c in feats.columns if not c.startswith("_")]
    return out.select(*[_c(c) for c in names])


def feature_table_blocked(bars: DataFrame, cfg: Config = DEFAULT, sentiment: DataFrame | None = None,
                          block_rows: int = 1 << 18) -> DataFrame:
    """Same table as ``plans.pipeline.feature_table``, laid out in row blocks."""
    pre = staged(preprocessed_blocked(bars, cfg, block_rows), "preprocessed")  # counted and read
    return features_from_preprocessed_blocked(pre, cfg, sentiment, block_rows)


def blocked_window(df: DataFrame, bucket: Column, order: str, back: int, fwd: int, fn,
                   block_rows: int = 1 << 16) -> DataFrame:
    """Run per-ticker ROWS-frame windows (reaching ``back`` rows behind, ``fwd`` ahead)
    in row blocks, so no ticker is processed whole in one task.

    ``bucket`` is a coarse ordering key monotone in ``order`` (e.g. the month of a
    date): rows are numbered per (ticker, bucket) and offset by the counts of the
    earlier buckets. ``fn(frame, keys, order_col)`` adds the window columns.
    """
    cols = list(df.columns)
    dealt = df.withColumn("_bk", bucket).repartition(KEY, "_bk")
    idx = dense_index(dealt, "_bk", order, "_i").drop("_bk")
    laid = lay_out(idx, "_i", block_rows, back, fwd)
    out = fn(laid, [KEY, "_blk"], "_i")
    return out.where(F.col("_own")).select(*[_c(c) for c in cols], *[
        _c(c) for c in out.columns if c not in cols and c not in ("_blk", "_own", "_i")])


def row_positions(df: DataFrame, bucket: Column, order: str) -> DataFrame:
    """Adds ``_rn`` (1-based position in the ticker) and ``_n`` (rows of the ticker)
    without a window over a whole ticker."""
    dealt = df.withColumn("_bk", bucket).repartition(KEY, "_bk")
    idx = dense_index(dealt, "_bk", order, "_i", total="_n").drop("_bk")
    return idx.withColumn("_rn", F.col("_i") + 1).drop("_i")


def display_indicators_blocked(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The display indicator set over raw bars, in row blocks."""
    return blocked_window(
        bars, month_number(F.col("date")), "date", feature_halo(cfg), 0,
        lambda df, keys, order: display_indicators(df, cfg.features, keys, order, order), cfg.layout.block_rows)
