"""Gap filling of hourly series from their own most alike lags, for each meter, and rolling bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators.cleaning import dealt
from meterloom.operators.resample import fill_ends, interpolate


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelation at lags 1 to `lags` about the whole mean and variance, over the pairs that are both there."""
    ok = np.isfinite(x)
    d, var = np.where(ok, x - x[ok].mean(), 0.0) if ok.any() else x * 0, np.var(x[ok]) if ok.any() else 0.0
    out = np.zeros(lags)
    if var <= 0:
        return out
    for k in range(1, min(lags, len(x) - 1) + 1):
        n = int((ok[k:] & ok[:-k]).sum())
        out[k - 1] = (d[k:] * d[:-k]).sum() / n / var if n else 0.0
    return out


def lags_for(n: int) -> int:
    """How many lags to look at, by the number of hours (fixed values: two weeks, one week, one day, and one more)."""
    return 337 if n > 6 * 168 else 169 if n > 3 * 168 else 25 if n > 3 * 24 else 0


def shifted(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if k > 0:
        out[k:] = x[:-k]
    elif k < 0:
        out[:k] = x[-k:]
    else:
        out[:] = x
    return out


def fill_by_lags(x: np.ndarray, lags: int, most: int | None = None) -> np.ndarray:
    """Nulls become the mean of the series' values at its most alike lags and leads.

    Ten passes ask for ever fewer of those values, from all to one; what one fills serves the next."""
    x = np.array(x, float)
    missing = int((~np.isfinite(x)).sum())
    if not missing or not lags:
        return x
    if missing == len(x):
        return x
    # How many lags a share of missing hours asks for, an even number.
    n = most or max(6, int(np.round((4.012 * np.log(missing / len(x)) + 24.38) / 2)) * 2)
    r = autocorrelation(x, lags)
    both = np.concatenate([np.arange(1, lags + 1), -np.arange(1, lags + 1)])
    picked = both[np.argsort(-np.concatenate([r, r]), kind="stable")[:n]]
    for need in np.linspace(len(picked), 1, 10).astype(int):
        hole = ~np.isfinite(x)
        if not hole.any():
            break
        near = np.stack([shifted(x, int(k))[hole] for k in picked])
        have = np.isfinite(near).sum(0)
        mean = np.where(np.isfinite(near), near, 0.0).sum(0) / np.maximum(have, 1)
        x[np.flatnonzero(hole)[have >= need]] = mean[have >= need]
    return x


def fill(df: DataFrame, value: str, key: str = "meter_id", ts: str = "ts", observed: bool = False) -> DataFrame:
    """df (one row an hour) with nulls of `value` filled by lags, then in time, then at the ends; interpolated_<value> marks them."""
    kind = df.schema[key].dataType.simpleString()

    def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        x = pdf[value].to_numpy(float)
        return pd.DataFrame({key: group[0], ts: pdf[ts], "_was": ~np.isfinite(x), "_x": fill_by_lags(x, lags_for(len(x)), None if observed else 6)})

    got = df.select(key, ts, F.col(value).cast("double").alias(value)).transform(dealt, key).groupBy(key).applyInPandas(one, f"{key} {kind}, {ts} {df.schema[ts].dataType.simpleString()}, _was boolean, _x double")
    got = got.withColumn("_x", F.when(~F.isnan("_x"), F.col("_x")))
    got = fill_ends(interpolate(got, "_x", (key,), ts).drop("interpolated"), "_x", (key,), ts)
    got = got.withColumn(f"interpolated_{value}", F.col("_was") & F.col("_x").isNotNull()).withColumnRenamed("_x", value).drop("_was")
    return df.drop(value).join(got, [key, ts])


def frames(x: np.ndarray, window: int, step: int = 1) -> np.ndarray:
    """Overlapping views of `window` values every `step`."""
    if window > len(x) or window < 1:
        raise ValueError("the window is longer than the data")
    return np.lib.stride_tricks.sliding_window_view(x, window)[:: max(step, 1)]


def rolling_band(x: np.ndarray, y: np.ndarray, sigma: float = 3.0, quantile: float = 0.25, window: float = 0.05, step: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) fences of y over windows of a share of the rows in order of x, brought back to x by lines."""
    order = np.argsort(x, kind="stable")
    n = max(int(round(len(x) * window)), 3)
    jump = max(int(round(n * step)), 1)
    xs, ys = frames(x[order], n, jump), frames(y[order], n, jump)
    q1, q3 = np.quantile(ys, [quantile, 1 - quantile], axis=1)
    wide = (q3 - q1) * (0.7413 * sigma - 0.5)
    middle = xs.mean(1)
    return np.interp(x, middle, q1 - wide), np.interp(x, middle, q3 + wide)


def rolling_scale(t: np.ndarray, resid: np.ndarray, mu: float, sigma: float = 3.0, quantile: float = 0.25, window: float = 0.2, step: float = 1.0) -> np.ndarray:
    low, high = rolling_band(t, resid - mu, sigma, quantile, window, step)
    return np.maximum(np.abs(low), np.abs(high))


def median_of_five(x: np.ndarray) -> np.ndarray:
    """Running median of five with the ends mirrored."""
    if len(x) < 3:
        return x.copy()
    return np.median(frames(np.pad(x, 2, mode="symmetric"), 5), axis=1)
