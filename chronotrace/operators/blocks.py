"""Numeric filters over dense series, run on bounded blocks of positions with a halo.

A series of a key is cut into blocks of consecutive positions; each block also receives
the rows within ``halo`` of it, so a task sees at most ``block + 2 * halo`` rows however
long the series is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrace.operators.ordered import join_on

BLOCK = 8192


def map_blocks(
    df: DataFrame, keys: tuple[str, ...], pos: str, value: str, halo: int, fn: Callable[[np.ndarray, int, int, int, int], np.ndarray], out: str, block: int = BLOCK
) -> DataFrame:
    """``fn(values, first_pos, n_total, lo, hi)`` returns the filtered values for positions
    lo..hi-1; ``values`` starts at position ``first_pos``. Positions run 0..n-1 per key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = join_on(df.select(*keys, pos, value), n, keys).withColumn("_home", F.floor(F.col(pos) / block).cast("long"))
    off = F.col(pos) - F.col("_home") * block
    last = F.floor((F.col("_n") - 1) / block).cast("long")
    homes = F.array_compact(
        F.array("_home", F.when((off < halo) & (F.col("_home") > 0), F.col("_home") - 1), F.when((off >= block - halo) & (F.col("_home") < last), F.col("_home") + 1))
    )
    d = d.withColumn("_blk", F.explode(homes)).drop("_home")
    schema = ", ".join([*(f"{k} bigint" for k in keys), f"{pos} bigint", f"{out} double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        total, blk, p = int(pdf["_n"].iloc[0]), int(pdf["_blk"].iloc[0]), pdf[pos].to_numpy()
        lo, hi = blk * block, min((blk + 1) * block, total)
        res = fn(pdf[value].to_numpy(dtype=float), int(p[0]), total, lo, hi)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, pos: np.arange(lo, hi), out: res})

    return d.groupBy(*keys, "_blk").applyInPandas(run, schema)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def gaussian_smooth(df: DataFrame, keys: tuple[str, ...], pos: str, value: str, sigma: float, out: str, block: int = BLOCK) -> DataFrame:
    """Gaussian filter with mirrored ends (the end value is repeated once)."""
    w = gaussian_weights(sigma)
    r = len(w) // 2

    def fn(x, first, total, lo, hi):
        idx = np.arange(lo - r, hi + r)
        period = 2 * total
        idx = np.mod(idx, period)
        idx = np.where(idx >= total, period - 1 - idx, idx)
        return np.convolve(x[idx - first], w, mode="valid")

    return map_blocks(df, keys, pos, value, r + 1, fn, out, max(block, 2 * r + 2))


def quadratic_smooth(df: DataFrame, keys: tuple[str, ...], pos: str, value: str, window: int, out: str, block: int = BLOCK) -> DataFrame:
    """Local quadratic least-squares smoothing over ``window`` points. Near both ends the fit
    of the first / last full window is evaluated off-centre. Series shorter than twice the
    window give no rows."""
    m = window // 2
    x = np.arange(-m, m + 1)
    s2, s4 = float((x**2).sum()), float((x**4).sum())
    q = x**2 - s2 / window

    def hat(x0: float) -> np.ndarray:
        return 1.0 / window + x0 * x / s2 + (x0**2 - s2 / window) * q / (s4 - s2**2 / window)

    hats = np.array([hat(k) for k in range(-m, m + 1)])

    def fn(v, first, total, lo, hi):
        i = np.arange(lo, hi)
        b = np.clip(i - m, 0, total - window)
        return (np.lib.stride_tricks.sliding_window_view(v, window)[b - first] * hats[i - b]).sum(axis=1)

    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2 * window).select(*keys)
    return map_blocks(join_on(df, n, keys), keys, pos, value, window, fn, out, block)
