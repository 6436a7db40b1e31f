"""Statistics over groups as aggregate expressions, and distribution quantiles in NumPy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1 / the normal quantile of 0.75.
MAD_SCALE = 1.4826022185056018


def iqr(c: Column) -> Column:
    return F.percentile(c, 0.75) - F.percentile(c, 0.25)


def column_summary(c: Column) -> dict[str, Column]:
    """Sum, mean, population variance and what follows from them, and skew and kurtosis corrected for bias."""
    n = F.count(c).cast("double")
    s, q = F.skewness(c), F.kurtosis(c)
    return {
        "n": F.count(c), "sum": F.sum(c), "mean": F.avg(c), "variance": F.var_pop(c), "std": F.stddev_pop(c), "cvstd": F.try_divide(F.stddev_pop(c), F.avg(c)),
        "sum_squared": F.sum(c * c), "median": F.percentile(c, 0.5), "iqr": iqr(c),
        "skew": F.when(n > 2, s * F.sqrt(n * (n - 1)) / (n - 2)), "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * q + 6)),
    }


def scaled_mad(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Median absolute deviation about each group's median, scaled to the normal's standard deviation."""
    middle = df.groupBy(*keys).agg(F.percentile(c, 0.5).alias("_m"))
    return df.join(middle, keys).groupBy(*keys).agg((F.percentile(F.abs(F.col(c) - F.col("_m")), 0.5) * MAD_SCALE).alias("mad_scaled"))


def min_max(df: DataFrame, keys: list[str], c: str, quantile: float = 0.1) -> DataFrame:
    """df with c brought to 0 and 1 at each group's quantiles `quantile` and 1 - `quantile`; a group without a spread between them has 0.5."""
    ends = df.groupBy(*keys).agg(F.percentile(c, quantile).alias("_a"), F.percentile(c, 1 - quantile).alias("_b"))
    scaled = F.when(F.col(c).isNull(), F.lit(None)).when(F.col("_a") == F.col("_b"), 0.5).otherwise((F.col(c) - F.col("_a")) / (F.col("_b") - F.col("_a")))
    return df.join(ends, keys).withColumn(c, scaled).drop("_a", "_b")


def kth(c: Column, k: int) -> Column:
    """The k-th smallest value of a group, or the -k-th largest; null if there are fewer."""
    return F.try_element_at(F.sort_array(F.collect_list(c)), F.lit(k))


def line(y: Column, x: Column) -> dict[str, Column]:
    """Least squares of y by x; where x has one value only, a flat line at the mean."""
    slope = F.regr_slope(y, x)
    both = y.isNotNull() & x.isNotNull()
    return {"slope": F.when(F.count(F.when(both, 1)) > 0, F.coalesce(slope, F.lit(0.0))), "intercept": F.coalesce(F.regr_intercept(y, x), F.avg(F.when(both, y)))}


def arg_min(what: Column, by: Column, order: Column) -> Column:
    """`what` of a group's row with the least `by`, the first in `order` among equals; rows without `by` don't count."""
    return F.min_by(what, F.when(by.isNotNull(), F.struct(by.alias("by"), order.alias("order"))))


def weighted_std(x: Column, w: Column) -> Column:
    """Standard deviation with weights brought to sum 1, over 1 - 1/n; null for fewer than two values."""
    n = F.sum(F.when(x.isNotNull() & w.isNotNull(), 1)).cast("double")
    mean = F.sum(w * x) / F.sum(w)
    spread = F.sum(w * x * x) / F.sum(w) - mean * mean
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) * n / (n - 1)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """Student's t quantile, by Newton steps between bounds that bisection tightens."""
    if not 0 < p < 1 or not df > 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, df)

    def below(t: float) -> float:
        return 1 - 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    t = (low + high) / 2
    for _ in range(200):
        miss = below(t) - p
        low, high = (t, high) if miss < 0 else (low, t)
        density = front * (1 + t * t / df) ** (-(df + 1) / 2)
        step = t - miss / density if density > 0 else low
        step = step if low < step < high else (low + high) / 2
        if abs(step - t) <= 1e-15 * high or step in (low, high):
            return step
        t = step
    return t


def t_value(alpha: float, n: float, tail: int = 2) -> float:
    return t_quantile(1 - alpha / tail, n - 1)


def interval_factor(n: float, interval: str = "PI", alpha: float = 0.1) -> float:
    """Half width of a confidence ("CI") or prediction ("PI") interval in standard deviations."""
    t = t_value(alpha, n)
    return t / math.sqrt(n) if interval == "CI" else t * (1 + 1 / math.sqrt(n))


def t_column(alpha: float, n: Column, tail: int = 2) -> Column:
    """t_value for a column of degrees, by a vectorised function over its distinct values."""
    import pandas as pd

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        known = {v: t_value(alpha, v, tail) if v == v and v is not None else None for v in x.dropna().unique()}
        return x.map(known).astype("float64")

    return of(n.cast("double"))
