"""Hourly regression by hour of week and temperature bins, for each meter and month segment.

The model of use is a level for each hour of the week and a piecewise-linear answer to
temperature, with other bins for occupied hours than for empty ones. Each segment weighs three
months. Features, occupancy and bins are aggregations; only the least squares of one segment
of one meter, at most a year of hours, runs in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions import calendar as cal
from meterloom.functions.stats import t_quantile
from meterloom.operators import features
from meterloom.operators.cleaning import dealt

ROW = "segment string, hours array<int>, levels array<double>, occupied_edges array<double>, empty_edges array<double>, occupied_slopes array<double>, empty_slopes array<double>, occupied_hours array<int>, n long, parameters int, mse double, mean_observed double, n_prime double"


def _parts(t: np.ndarray, edges: np.ndarray) -> np.ndarray:
    if not len(edges):
        return t[:, None]
    low = np.concatenate([[-np.inf], edges])
    out = [np.minimum(t, edges[0])]
    for a, b in zip(low[1:], [*edges[1:], np.inf]):
        out.append(np.clip(t - a, 0, b - a))
    return np.column_stack(out)


def _edges(t: np.ndarray, least: int, edges=tuple(features.BIN_EDGES)) -> np.ndarray:
    """Edges left when bins of fewer than `least` temperatures join a neighbour, outer ones first."""
    edges = [float(e) for e in edges]
    while edges:
        n = np.bincount(np.searchsorted(edges, t, "left"), minlength=len(edges) + 1)
        if n[0] < least:
            edges.pop(0)
        elif n[-1] < least:
            edges.pop()
        else:
            small = np.flatnonzero(n[1:-1] < least)
            if not len(small):
                break
            edges.pop(int(small[0]) + 1)
    return np.array(edges)


def _occupied(hour: np.ndarray, v: np.ndarray, t: np.ndarray, w: np.ndarray, share: float) -> np.ndarray:
    x = np.column_stack([np.ones(len(t)), np.maximum(t - 65, 0), np.maximum(50 - t, 0)])
    sw = np.sqrt(w)
    beta, *_ = np.linalg.lstsq(x * sw[:, None], v * sw, rcond=None)
    up = (v - x @ beta) > 0
    n = np.bincount(hour, minlength=168)
    return np.where(n > 0, np.bincount(hour, up, 168) / np.maximum(n, 1) > share, True)


def fit_segment(hour: np.ndarray, t: np.ndarray, v: np.ndarray, w: np.ndarray, share: float = 0.65, least: int = 20) -> dict:
    """Least squares of one segment, hours never seen having no level."""
    occupied = _occupied(hour, v, t, w, share)
    on = occupied[hour]
    oe, ee = _edges(t[on], least), _edges(t[~on], least)
    po, pe = _parts(t, oe) * on[:, None], _parts(t, ee) * ~on[:, None]
    seen = np.unique(hour)
    # Levels are means of what the slopes leave, so they are taken out first (weighted by hour of week)
    # and only the slopes, at most 14, are solved for.
    slopes = np.column_stack([po, pe])
    mass = np.bincount(hour, w, 168)

    def centred(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.bincount(hour, w * c, 168) / np.where(mass > 0, mass, 1)
        return c - mean[hour], mean

    inner, means = (np.stack(a) for a in zip(*(centred(c) for c in slopes.T)))
    free, level = centred(v)
    sw = np.sqrt(w)
    bend, *_ = np.linalg.lstsq((inner * sw).T, free * sw, rcond=None)
    beta = np.concatenate([(level - bend @ means)[seen], bend])
    fully = w == 1
    resid = (free - bend @ inner)[fully] if fully.any() else np.zeros(0)
    n, p = len(resid), len(beta)
    r = np.corrcoef(resid[1:], resid[:-1])[0, 1] if n > 2 and np.std(resid) > 0 else 0.0
    n_prime = n * (1 - r) / (1 + r) if np.isfinite(r) and r > -1 else float(n)
    k = len(seen)
    return {"hours": seen.tolist(), "levels": beta[:k].tolist(), "occupied_edges": oe.tolist(), "empty_edges": ee.tolist(), "occupied_slopes": beta[k : k + po.shape[1]].tolist(), "empty_slopes": beta[k + po.shape[1] :].tolist(), "occupied_hours": np.flatnonzero(occupied).tolist(), "n": n, "parameters": int(p), "mse": float((resid**2).sum() / max(n - p, 1)) if n else None, "mean_observed": float(v[fully].mean()) if n else None, "n_prime": float(max(n_prime, 1.0))}


class SegmentedModel:
    """Segments: three_month_weighted, or single for demand response."""

    def __init__(self, segments: str = "three_month_weighted", share: float = 0.65, least: int = 20, alpha: float = 0.1):
        self.segments, self.share, self.least, self.alpha = segments, share, least, alpha

    def fit(self, hours: DataFrame, key: str = "meter_id") -> DataFrame:
        """hours: key, ts, temperature, observed. Partial rows are left out; a segment without rows has none."""
        rows = hours.where("observed is not null and temperature is not null").select(key, "ts", F.col("observed").cast("double").alias("v"), F.col("temperature").cast("double").alias("t"), cal.hour_of_week("ts").alias("h"))
        rows = features.segment_weights(rows, self.segments, drop_zero=True)
        kind, share, least = hours.schema[key].dataType.simpleString(), self.share, self.least
        names = [c.split()[0] for c in ROW.split(", ")]

        def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts")
            got = fit_segment(pdf["h"].to_numpy(), pdf["t"].to_numpy(), pdf["v"].to_numpy(), pdf["weight"].to_numpy(), share, least)
            return pd.DataFrame([[group[0], group[1], *(got[c] for c in names[1:])]], columns=[key, *names])

        return dealt(rows, key, "segment").groupBy(key, "segment").applyInPandas(one, f"{key} {kind}, {ROW}")

    def predict(self, params: DataFrame, hours: DataFrame, key: str = "meter_id") -> DataFrame:
        """hours with predicted, by the segment in whose middle the month is; null where the hour of week was never seen."""
        if self.segments == "single":
            name = F.lit("all")
        else:
            m = [features.MONTHS[i % 12] for i in range(-1, 13)]
            end = "-weighted" if self.segments.endswith("weighted") else ""
            name = F.element_at(F.array(*[F.lit("-".join(m[i : i + 3]) + end) for i in range(12)]), F.month("ts"))
        j = hours.withColumns({"_h": cal.hour_of_week("ts"), "segment": name}).join(params, [key, "segment"], "left")
        level = F.try_element_at("levels", F.array_position("hours", F.col("_h")).cast("int"))
        busy = F.array_contains("occupied_hours", F.col("_h"))
        t = F.col("temperature")

        def answer(edges: str, slopes: str):
            # Position 0 has no low edge; try_element_at counts from 1.
            def safe(s, i):
                low = F.when(i > 0, F.try_element_at(F.col(edges), F.greatest(i, F.lit(1))))
                high = F.try_element_at(F.col(edges), i + 1)
                first = F.when(high.isNull(), t).otherwise(F.least(t, high))
                above = F.greatest(t - low, F.lit(0.0))
                return s * F.when(i == 0, first).when(high.isNull(), above).otherwise(F.least(above, high - low))

            return F.aggregate(F.transform(slopes, safe), F.lit(0.0), lambda a, b: a + b)

        p = level + F.when(busy, answer("occupied_edges", "occupied_slopes")).otherwise(answer("empty_edges", "empty_slopes"))
        return j.select(*hours.columns, "segment", p.alias("predicted"))

    def monthly_uncertainty(self, params: DataFrame, predicted: DataFrame, key: str = "meter_id") -> DataFrame:
        """Savings' uncertainty of each month: 1.26 t sum(observed) / (m mean) sqrt(MSE n / n' (1 + 2 / n') m), and that by hour."""
        g = predicted.where("observed is not null and predicted is not null").groupBy(key, F.month("ts").alias("month"), "segment").agg(F.count("*").alias("m"), F.sum("observed").alias("observed"), F.sum("predicted").alias("predicted"))
        alpha = self.alpha

        @F.pandas_udf("double")
        def t_of(free: pd.Series) -> pd.Series:
            return free.map(lambda x: t_quantile(1 - alpha / 2, max(x, 1.0)))

        j = g.join(params.select(key, "segment", "n", "parameters", "mse", "mean_observed", "n_prime"), [key, "segment"])
        t = t_of((F.col("n") - F.col("parameters")).cast("double"))
        u = 1.26 * t * F.col("observed") / (F.col("m") * F.col("mean_observed")) * F.sqrt(F.col("mse") * F.col("n") / F.col("n_prime") * (1 + 2 / F.col("n_prime")) * F.col("m"))
        return j.select(key, "month", "m", "observed", "predicted", u.alias("uncertainty"), F.sqrt(u * u / F.col("m")).alias("hour_uncertainty"))


class DemandResponseModel(SegmentedModel):
    """One segment of all rows."""

    def __init__(self, **options):
        super().__init__("single", **options)
