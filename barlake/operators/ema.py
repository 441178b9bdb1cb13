"""Exponential moving average with ``adjust=False`` from window functions only.

y0 = x0, yt = b*y(t-1) + a*xt with a = 2/(span+1), b = 1-a. Unrolled:
yt = sum_j b^(t-j) * x'j with x'0 = x0 and x'j = a*xj otherwise.

Rows are cut into blocks of B rows by their per-ticker position i. Inside a
block (position k = i mod B) the sum is b^k * running_sum(x'j * b^-j), a plain
running window over ``partitionBy(ticker, block)``. The carry from earlier
blocks enters as b^(k+1) * S, where S is the previous block's end value, read
with ``last(ignorenulls)`` over an unbounded-preceding frame (incremental, O(1)
per row). B is chosen with B*|ln b| near 300, so b^-k stays far from overflow
and the contribution of blocks older than the previous one is below b^B =
e^-300 relative: the result is exact in double precision, linear time, no
join and no extra exchange (the blocks refine the ticker partitioning).

Several EMAs over the same rows are computed side by side in the same
projections (three selects in all), which keeps the plan shallow; when one
block size suits every span (``shared_block_size``) they share one partition
spec and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DECAY_PER_BLOCK = 300.0
_MIN_DECAY = 40.0   # older blocks contribute below e^-40 relative
_MAX_GROWTH = 500.0  # b^-k stays below e^500


def block_size(beta: float) -> int:
    if beta <= 0.0:
        return 1
    return max(1, int(_DECAY_PER_BLOCK / -math.log(beta)))


def shared_block_size(betas: list[float]) -> int | None:
    """One block size valid for every decay rate (one partition spec, one sort), if any."""
    logs = [-math.log(b) for b in betas if b > 0.0]
    if not logs:
        return None
    lo = max(math.ceil(_MIN_DECAY / x) for x in logs)
    hi = min(math.floor(_MAX_GROWTH / x) for x in logs)
    return hi if lo <= hi else None


def add_emas(df: DataFrame, specs: list[tuple[str, Column | str, int]],
             key: str = "ticker", order: str = "date", index: str | None = None) -> DataFrame:
    """Append one column per ``(out, src, span)``: EMA(span, adjust=False) of src.

    ``index`` names an existing 0-based per-key position column; without it a
    ``row_number`` is added (and dropped again).
    """
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    w = Window.partitionBy(*keys).orderBy(order)
    keep = list(df.columns)
    i = index or "_ema_i"
    if index is not None and index in keep:
        keep = [c for c in keep if c != index] + [index]
    if index is None:
        df = df.withColumn(i, F.row_number().over(w) - 1)
    stage1, stage2, stage3 = {}, {}, {}
    shared = shared_block_size([1.0 - 2.0 / (span + 1.0) for _, _, span in specs])
    for out, src, span in specs:
        x = F.col(src) if isinstance(src, str) else src
        alpha = 2.0 / (span + 1.0)
        beta = 1.0 - alpha
        if beta <= 0.0:
            stage3[out] = x
            continue
        B = shared or block_size(beta)
        tag = f"s{B}" if shared else out
        b, k, loc = f"_ema_{tag}_b", f"_ema_{tag}_k", f"_{out}_loc"
        stage1[b] = F.floor(F.col(i) / B)
        stage1[k] = F.col(i) % B
        stage1[f"_{out}_x"] = F.when(F.col(i) == 0, x).otherwise(F.lit(alpha) * x)
        in_block = Window.partitionBy(*keys, b).orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        stage2[loc] = F.pow(F.lit(beta), F.col(k)) * F.sum(
            F.col(f"_{out}_x") * F.pow(F.lit(beta), -F.col(k))).over(in_block)
        end_val = F.when(F.col(k) == B - 1, F.col(loc))
        carry = F.coalesce(
            F.last(end_val, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0.0))
        stage3[out] = F.col(loc) + F.pow(F.lit(beta), F.col(k) + 1) * carry
    if stage1:
        df = df.withColumns(stage1).withColumns(stage2)
    df = df.withColumns(stage3)
    return df.select(*keep, *[out for out, _, _ in specs if out not in keep])


def add_ema(df: DataFrame, out: str, src: str | Column, span: int,
            key: str = "ticker", order: str = "date") -> DataFrame:
    return add_emas(df, [(out, src, span)], key, order)
