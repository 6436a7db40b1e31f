"""Robust statistics in NumPy: fences, the general loss, and weights of a shape chosen from the data."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def weighted_quantile(values: np.ndarray, q, weights: np.ndarray | None = None) -> np.ndarray:
    """Quantiles by linear interpolation over the middle of each value's share of the weights."""
    values = np.asarray(values, float)
    weights = np.ones(len(values)) if weights is None else np.asarray(weights, float)
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    return np.interp(q, (np.cumsum(w) - w / 2) / w.sum(), v)


def fence(x: np.ndarray, weights: np.ndarray | None = None, sigma: float = 3.0, quantile: float = 0.25) -> np.ndarray:
    """[low, high]: quartiles widened by the range between them, so that a normal's are at sigma deviations."""
    x = np.asarray(x, float)
    ok = ~np.isnan(x)
    if weights is None:
        q1, q3 = np.quantile(x[ok], [quantile, 1 - quantile])
    else:
        q1, q3 = weighted_quantile(x[ok], [quantile, 1 - quantile], weights[ok])
    wide = (q3 - q1) * (0.7413 * sigma - 0.5)
    return np.array([q1 - wide, q3 + wide])


def scale_of(resid: np.ndarray, mu: float, sigma: float = 3.0, quantile: float = 0.25) -> float:
    """The larger end of the fence of residuals about mu; where that is 0, a tenth of their magnitude, or 1."""
    c = float(np.abs(fence(resid - mu, None, sigma, quantile)).max())
    if c > 0:
        return c
    most = np.abs(resid - mu).max(initial=0.0)
    return float(10.0 ** np.floor(np.log10(most))) if most > 0 else 1.0


def loss(x: np.ndarray, a: float) -> np.ndarray:
    """The general robust loss of shape a."""
    y = 0.5 * x * x
    if a == 2:
        return y
    if a == 0:
        return np.log1p(y)
    if a <= -1e6:
        return -np.expm1(-y)
    b = abs(a - 2)
    return b / a * ((2 * y / b + 1) ** (a / 2) - 1)


def weights(x: np.ndarray, a: float, least: float = 0.0) -> np.ndarray:
    """Weights under that loss. Values at or under 0 keep weight 1."""
    y = 0.5 * x * x
    if a == 2:
        w = np.ones_like(x)
    elif a == 0:
        w = 1 / (y + 1)
    elif a <= -1e6:
        w = np.exp(-y)
    else:
        w = (2 * y / abs(a - 2) + 1) ** (a / 2 - 1)
    return np.where(x > 0, least + (1 - least) * w, 1.0)


@lru_cache(maxsize=4096)
def log_partition(a: float) -> float:
    """ln of the integral of exp(-loss), over [-1e5, 1e5] where the tails don't end."""
    if a < 0:
        grid = np.concatenate([np.linspace(0, 20, 8001), np.geomspace(20, 1e5, 8001)[1:]])
    else:
        grid = np.concatenate([np.linspace(0, 30, 12001), np.geomspace(30, 1e8, 12001)[1:]])
    return float(np.log(2 * np.trapezoid(np.exp(-loss(grid, a)), grid)))


#: The least shape, the decades and the power of the curve up to shape 2, the middle and width of that beyond.
LEAST_SHAPE, DECADES, POWER, MIDDLE, WIDTH = -100.0, 3.0, 0.25, 1.0, 1.5


def shape_at(s: float, top: float = 2.0) -> float:
    """Shape for s from 0 to 1: up to 2 along a hyperbolic tangent, with closer steps towards the top; for another
    top along a logistic curve from -100 to 100."""
    s = float(np.clip(s, 0, 1))
    if top == 2:
        reach = DECADES * np.log(10) / 2
        return LEAST_SHAPE + (2 - LEAST_SHAPE) * float(np.tanh(reach * s**POWER) / np.tanh(reach))
    if s in (0.0, 1.0):
        return 100.0 if s else -100.0
    return float(np.clip(MIDDLE + WIDTH * np.log(s / (1 - s)), -100, 100))


def golden_section(f, a: float, b: float, tol: float = 1e-5) -> float:
    """The minimum of f between a and b."""
    g = (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def choose_shape(x: np.ndarray) -> float:
    """The shape under which scaled residuals are likeliest, partition included."""
    return shape_at(golden_section(lambda s: float(loss(x, shape_at(s)).sum() + len(x) * log_partition(round(shape_at(s), 3))), 0.0, 1.0, 1e-3))


def adaptive_weights(resid: np.ndarray, shape: float | str = "adaptive", sigma: float = 3.0, quantile: float = 0.25, least: float = 0.0) -> tuple[np.ndarray, float, float]:
    """(weights, scale, shape) of residuals about the median of those inside the fence."""
    resid = np.where(np.isfinite(resid), resid, 0.0)
    if shape == 2 or len(resid) < 3:
        return np.ones(len(resid)), 1.0, 2.0
    low, high = fence(resid, None, sigma, quantile)
    inside = resid[(resid >= low) & (resid <= high)]
    mu = float(np.median(inside if len(inside) else resid))
    c = scale_of(resid, mu, sigma, quantile)
    x = (resid - mu) / c
    a = choose_shape(x) if shape == "adaptive" else float(shape)
    return weights(x, a, least), c, a


def theil_sen(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept): median of the slopes of all pairs with different x."""
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    ok = dx != 0
    slope = float(np.median((y[j] - y[i])[ok] / dx[ok])) if ok.any() else 0.0
    return slope, float(np.median(y) - slope * np.median(x))
