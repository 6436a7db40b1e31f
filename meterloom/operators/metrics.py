"""Error metrics of predictions by meter, savings and their uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.scalar import divide
from meterloom.functions.stats import iqr
from meterloom.operators.cleaning import KEY, in_order


def with_lag(df: DataFrame, c: str, k: int = 1, keys=KEY, ts: str = "ts") -> DataFrame:
    return df.withColumn(f"{c}_lag", F.lag(c, k).over(in_order(keys, ts)))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of the rows with both, null where either doesn't vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b))))


def autocorrelation(df: DataFrame, c: str, k: int = 1, keys=KEY, ts: str = "ts") -> DataFrame:
    """Pearson correlation of c with itself k rows before."""
    return with_lag(df, c, k, keys, ts).groupBy(*keys).agg(correlation(c, f"{c}_lag").alias("autocorr"), F.count(c).alias("n"))


def acf(df: DataFrame, c: str, k: int = 1, keys=KEY, ts: str = "ts") -> DataFrame:
    """Autocovariance at lag k over the variance, both about the whole mean and over all rows."""
    mean = df.groupBy(*keys).agg(F.avg(c).alias("_m"), F.var_pop(c).alias("_v"), F.count(c).alias("_n"))
    d = df.join(mean, list(keys)).withColumn("_x", F.col(c) - F.col("_m"))
    d = with_lag(d, "_x", k, keys, ts)
    return d.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("_x_lag")) / F.max(F.col("_n") * F.col("_v"))).alias("acf"))


def effective_n(n: Column, r: Column) -> Column:
    """Rows that as many independent ones are worth: n (1 - r) / (1 + r)."""
    return F.coalesce(F.try_divide(n * (1 - r), 1 + r), n.cast("double"))


def fit_metrics(df: DataFrame, parameters: int | Column, keys=KEY, ts: str = "ts", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Metrics of predictions against use, residuals being observed less predicted, one row a meter.

    *_adj take parameters from the rows, *_autocorr_adj from the effective rows, at least 1."""
    df = df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull()).withColumn("_r", F.col(observed) - F.col(predicted))
    df = with_lag(df, "_r", 1, keys, ts)
    p = parameters if isinstance(parameters, Column) else F.lit(parameters)
    o, e, r = F.col(observed), F.col(predicted), F.col("_r")
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(o).alias("_mean"), iqr(o).alias("_iqr"), F.sum(r * r).alias("sse"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("mbe"),
        F.coalesce(correlation("_r", "_r_lag"), F.lit(0.0)).alias("_rho"), correlation(observed, predicted).alias("_c"), F.avg(F.abs(F.when(o != 0, r / o))).alias("mape"), (F.sum(o * o) - F.count(o) * F.avg(o) * F.avg(o)).alias("_sst"), p.alias("_p") if not isinstance(parameters, Column) else F.max(p).alias("_p"),
    )
    n = F.col("n")
    g = g.withColumn("n_prime", effective_n(n, F.col("_rho")))
    g = g.withColumn("ddof", F.greatest(n - F.col("_p"), F.lit(1)).cast("double")).withColumn("ddof_autocorr", F.greatest(F.col("n_prime") - F.col("_p"), F.lit(1.0)))
    g = g.withColumn("mse", F.col("sse") / n).withColumns({"rmse": F.sqrt(F.col("sse") / n), "rmse_adj": F.sqrt(F.col("sse") / F.col("ddof")), "rmse_autocorr_adj": F.sqrt(F.col("sse") / F.col("ddof_autocorr"))})
    out = {"nmae": divide(F.col("mae"), F.col("_mean")), "pnmae": divide(F.col("mae"), F.col("_iqr")), "nmbe": divide(F.col("mbe"), F.col("_mean")), "pnmbe": divide(F.col("mbe"), F.col("_iqr"))}
    for end in ("", "_adj", "_autocorr_adj"):
        out[f"cvrmse{end}"], out[f"pnrmse{end}"] = divide(F.col(f"rmse{end}"), F.col("_mean")), divide(F.col(f"rmse{end}"), F.col("_iqr"))
    r2 = F.col("_c") * F.col("_c")
    out |= {"r_squared": r2, "r_squared_adj": 1 - (1 - r2) * (n - 1) / F.greatest(n - F.col("_p") - 1, F.lit(1))}
    return g.withColumns(out).drop("_mean", "_iqr", "_rho", "_c", "_sst", "_p")


def polynomial(months: Column, interval: str) -> Column:
    """Factor of the savings' uncertainty by the number of months reported (fixed values)."""
    if interval == "hourly":
        return F.lit(1.26)
    a, b, c = (-0.00024, 0.03535, 1.00286) if interval == "daily" else (-0.00022, 0.03306, 0.94054)
    return a * months * months + b * months + c


def savings(df: DataFrame, keys=KEY, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """Predicted less observed by row, null where either is."""
    return df.withColumn("savings", F.col(predicted) - F.col(observed))


def savings_totals(report: DataFrame, base: DataFrame, interval: str = "daily", t: float | Column = 1.65, keys=KEY, ts: str = "ts") -> DataFrame:
    """Savings of each meter with fractional uncertainty.

    report: observed, predicted. base: rows n, n_prime, cvrmse_autocorr_adj of the baseline. With m
    reported rows, E predicted in total and t for the confidence:
    U = E t cv sqrt(n / (m n') (1 + 2 / n')) times the months' factor."""
    whole = report.where("observed is not null and predicted is not null")
    got = whole.groupBy(*keys).agg(F.count("*").alias("m"), F.sum("predicted").alias("predicted"), F.sum("observed").alias("observed"), F.countDistinct(F.month(ts)).cast("double").alias("months"))
    t = t if isinstance(t, Column) else F.lit(t)
    j = got.join(base.select(*keys, "n", "n_prime", "cvrmse_autocorr_adj"), list(keys))
    n, np_, m = F.col("n"), F.col("n_prime"), F.col("m")
    u = F.col("predicted") * t * F.col("cvrmse_autocorr_adj") * F.sqrt(n / (m * np_) * (1 + 2 / np_)) * polynomial(F.col("months"), interval)
    j = j.withColumn("savings", F.col("predicted") - F.col("observed")).withColumn("uncertainty", u)
    return j.withColumn("fractional_uncertainty", F.try_divide("uncertainty", "savings")).withColumn("point_uncertainty", F.col("uncertainty") / F.sqrt(m)).drop("n", "n_prime", "cvrmse_autocorr_adj")


def modeled_savings(base: DataFrame, report: DataFrame, keys=KEY, ts: str = "ts") -> DataFrame:
    """Baseline prediction less reporting prediction on the same times, such as a normal year."""
    r = report.select(*keys, ts, F.col("predicted").alias("reporting"))
    return base.select(*keys, ts, F.col("predicted").alias("baseline")).join(r, [*keys, ts]).withColumn("savings", F.col("baseline") - F.col("reporting"))


def ols_error(t: Column, rmse: Column, post_obs: Column, base_obs: Column, base_avg: Column, post_avg: Column, base_var: Column) -> Column:
    """Model and noise error of a regression's total in quadrature."""
    model = t * rmse * post_obs / F.sqrt(base_obs) * F.sqrt(1 + (base_avg - post_avg) ** 2 / base_var)
    noise = t * rmse * F.sqrt(post_obs)
    return F.sqrt(model * model + noise * noise)


def criterion(loss: Column, k: Column, n: Column, kind: str = "bic", c0: float = 0.24, d0: float = 2.061, tss: Column | None = None) -> Column:
    """Selection criterion of a model with k components and a sum of squares `loss` over n rows; smaller is better.

    The information criteria are -2 log-likelihood of least squares and a penalty, over n; a loss of 0
    makes them minus infinity. tss is the total sum of squares, for the r_squared kinds."""
    spare = F.greatest(n - k - 1, F.lit(1e-6))
    likelihood = F.when(loss <= 0, F.lit(float("inf"))).otherwise(-n / 2 * (math.log(2 * math.pi) + 1 + F.log(loss / n)))
    plain = {
        "rmse": lambda: F.sqrt(loss / n), "rmse_adj": lambda: F.sqrt(loss / spare), "fpe": lambda: loss * (n + k + 1) / spare,
        "r_squared": lambda: 100 * loss / tss, "r_squared_adj": lambda: 100 * loss / tss * (n - 1) / spare,
    }
    if kind in plain:
        return plain[kind]()
    penalty = {
        "aic": 2 * F.pow(k, F.lit(d0)), "aicc": F.pow(2 * k + 2 * k * (k + 1) / spare, F.lit(d0)), "caic": k * F.pow(F.log(n) + 1, F.lit(d0)),
        "bic": k * F.pow(F.log(n), F.lit(d0)), "sabic": k * F.pow(F.log((n + 2) / 24), F.lit(d0)),
    }
    if kind not in penalty:
        raise NotImplementedError(f"criterion {kind}")
    return (-2 * likelihood + c0 * penalty[kind]) / n


def legacy_metrics(df: DataFrame, parameters: int, keys=KEY, ts: str = "ts", observed: str = "observed", predicted: str = "predicted", lags: int = 1) -> DataFrame:
    """The older metrics: residuals are predicted less observed, and normalised by the mean or sum of use."""
    df = df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull()).withColumn("_r", F.col(predicted) - F.col(observed))
    df = with_lag(df, "_r", lags, keys, ts)
    r, n = F.col("_r"), F.col("n")
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(observed).alias("observed_mean"), F.stddev_samp(observed).alias("observed_std"), F.avg(predicted).alias("predicted_mean"), F.sum(observed).alias("_sum"), F.sum(r * r).alias("_sse"), F.sum(F.abs(r)).alias("_sae"), F.sum(r).alias("_sr"), correlation(observed, predicted).alias("_c"), correlation("_r", "_r_lag").alias("autocorr_resid"), F.avg(F.when(F.col(observed) != 0, F.abs(r / F.col(observed)))).alias("mape"))
    r2 = F.col("_c") * F.col("_c")
    out = {"r_squared": r2, "r_squared_adj": F.when(n > parameters + 1, 1 - (1 - r2) * (n - 1) / (n - parameters - 1)), "rmse": F.sqrt(F.col("_sse") / n), "rmse_adj": F.when(n > parameters, F.sqrt(F.col("_sse") / (n - parameters)))}
    g = g.withColumns(out).withColumns({"cvrmse": F.try_divide("rmse", "observed_mean"), "cvrmse_adj": F.try_divide("rmse_adj", "observed_mean"), "nmae": F.try_divide("_sae", "_sum"), "nmbe": F.try_divide("_sr", "_sum"), "n_prime": effective_n(n, F.col("autocorr_resid"))})
    np_ = F.col("n_prime")
    return g.withColumn("fsu_base_term", F.col("cvrmse_adj") * F.sqrt(n / np_ * (1 + 2 / np_))).drop("_sum", "_sse", "_sae", "_sr", "_c")


def fractional_error(t: Column, rmse: Column, post_obs: Column, base_obs: Column, base_avg: Column, post_avg: Column, n_prime: Column, interval: str) -> Column:
    """Error of a total by the polynomial in months: of bills those reported, else 30 rows to a month."""
    months = post_obs if interval == "billing" else post_obs / 30.0
    return t * post_avg * rmse / base_avg * F.sqrt(base_obs / n_prime * (1 + 2 / n_prime) * post_obs) * polynomial(months, "billing" if interval == "billing" else "daily")
