"""Numeric column expressions: guarded arithmetic, bins, and the degree-day response."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_MAX = math.log(1.7976931348623157e308)


def to_null(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def fahrenheit(celsius: Column) -> Column:
    return 32.0 + 1.8 * celsius


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    """c bounded to [low, high]; null and NaN stay."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(c.isNull() | F.isnan(c), c).when(c < low, low).when(c > high, high).otherwise(c)


def magnitude(c: Column, method: str = "round") -> Column:
    """log10 of the absolute value by method round (half to even), floor, ceil or exact; 1 for 0."""
    exact = F.log10(F.abs(c))
    of = {"round": F.bround(exact, 0), "floor": F.floor(exact).cast("double"), "ceil": F.ceil(exact).cast("double"), "exact": exact}
    if method not in of:
        raise ValueError(f"unknown method {method}")
    return F.when(c == 0, F.lit(1.0)).otherwise(of[method])


def significant(c: Column, digits: int) -> Column:
    """c rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - magnitude(c, "floor"))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c * scale) / scale)


def divide(top: Column, bottom: Column, least: float = 1e-3) -> Column:
    """top / bottom, null when the bottom is near zero and the top isn't."""
    return F.when((bottom <= least) & (top > 10 * least), F.lit(None).cast("double")).otherwise(F.try_divide(top, bottom))


def one_hot(c: Column, values: list, prefix: str) -> list[Column]:
    """A column of 0 or 1 for each of fixed values."""
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def cut_bin(c: Column, edges: list[float]) -> Column:
    """Number of the bin (edge[i-1], edge[i]] that holds c, the outer bins being open; null stays."""
    if not edges:
        return F.when(c.isNotNull(), 0)
    out = F.when(c <= edges[0], 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(c <= e, i)
    return out.when(c > edges[-1], len(edges))


def bin_parts(c: Column, edges: list[float]) -> list[Column]:
    """Parts of c that fall in each bin: min(c, e0), then what is above an edge up to the bin's width."""
    if not edges:
        return [c]
    out = [F.when(c.isNotNull(), F.least(c, F.lit(float(edges[0]))))]
    for low, high in zip(edges, edges[1:]):
        out.append(clip(c - float(low), 0.0, float(high - low)))
    return [*out, F.when(c.isNotNull(), F.greatest(c - float(edges[-1]), F.lit(0.0)))]


def smoothing(hdd_bp: Column, hdd_share: Column, cdd_bp: Column, cdd_share: Column, least: float = 0.01) -> dict[str, Column]:
    """Breakpoints and smoothing lengths from smoothing as shares of the flat part.

    Shares that are both under `least` are 0, shares over 1 in sum are brought to 1; each length
    moves its breakpoint inward."""
    none = (hdd_share < least) & (cdd_share < least)
    total = F.greatest(hdd_share + cdd_share, F.lit(1.0))
    gap = cdd_bp - hdd_bp
    hk, ck = (F.when(none, F.lit(0.0)).otherwise(s / total * gap) for s in (hdd_share, cdd_share))
    return {"hdd_bp": hdd_bp + hk, "hdd_k": hk, "cdd_bp": cdd_bp - ck, "cdd_k": ck}


def response(t: Column, p: dict[str, Column]) -> Column:
    """Use at temperature t of a heating arm, a flat part and a cooling arm.

    p: hdd_bp, hdd_beta, hdd_k, cdd_bp, cdd_beta, cdd_k, intercept, and t_min, t_max of the fit. With
    breakpoints in the wrong order the arms change places. Equal breakpoints at or beyond an end
    of the fitted range give one arm everywhere. A smoothing length adds an exponential that
    rounds the corner."""
    swap = p["cdd_bp"] < p["hdd_bp"]

    def pick(a: str, b: str) -> Column:
        return F.when(swap, p[b]).otherwise(p[a])

    hb, hs, hk = pick("hdd_bp", "cdd_bp"), pick("hdd_beta", "cdd_beta"), pick("hdd_k", "cdd_k")
    cb, cs, ck = pick("cdd_bp", "hdd_bp"), pick("cdd_beta", "hdd_beta"), pick("cdd_k", "hdd_k")
    same = hb == cb
    heating = (t < hb) | (same & (cb >= p["t_max"]))
    cooling = (t > cb) | (same & (hb <= p["t_min"]))

    def arm(bp: Column, slope: Column, k: Column) -> Column:
        power = clip(F.try_divide(t - bp, k), -LOG_MAX, LOG_MAX)
        return slope * (t - bp) + p["intercept"] + F.when(k == 0, F.lit(0.0)).otherwise(F.abs(slope * k) * (F.exp(power) - 1))

    flat = (p["hdd_beta"] == 0) & (p["cdd_beta"] == 0)
    return F.when(t.isNull(), F.lit(None).cast("double")).when(flat, p["intercept"]).when(heating, arm(hb, -hs, hk)).when(cooling, arm(cb, cs, -ck)).otherwise(p["intercept"])


def robust_loss(x: Column, a: float) -> Column:
    """The general robust loss of scaled residual x with shape a (2: squares, 0: Cauchy, -inf: Welsch)."""
    if a == 2:
        return 0.5 * x * x
    if a == 0:
        return F.log1p(0.5 * x * x)
    if a == float("-inf"):
        return 1 - F.exp(-0.5 * x * x)
    b = abs(a - 2)
    return b / a * (F.pow(x * x / b + 1, F.lit(a / 2)) - 1)


def robust_slope(x: Column, a: float) -> Column:
    """The derivative of that loss: the residual times its weight, on both sides of 0."""
    return x * _fall(x, a)


def robust_weight(x: Column, a: float, least: float = 0.0) -> Column:
    """Weight of a scaled residual under that loss; residuals at or under 0 keep weight 1."""
    return F.when(x <= 0, F.lit(1.0)).otherwise(_fall(x, a) * (1 - least) + least)


def _fall(x: Column, a: float) -> Column:
    if a == 2:
        return F.lit(1.0)
    if a == 0:
        return 1 / (0.5 * x * x + 1)
    if a == float("-inf"):
        return F.exp(-0.5 * x * x)
    return F.pow(x * x / abs(a - 2) + 1, F.lit(a / 2 - 1))


def edge_terms(t: Column, low: float, high: float, rate: float, scale: float = 1.0) -> list[Column]:
    """Exponentials that grow and fall over [low, high], temperature brought to [-1, 1]."""
    x = (2 * (t - low) / (high - low) - 1) if high != low else t * 0
    return [scale * F.exp(F.lit(s / rate) * x) - scale for s in (1.0, -1.0)]
