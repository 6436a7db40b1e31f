"""Hourly model: an elastic net from a day's temperatures to its 24 hours of use, for each meter.

A day's features are its 24 standardised temperatures (and irradiance, if there is any) within
temperature bins and within clusters of month and weekday whose mean profiles are alike, what
bin and cluster the day is in, and columns that the settings name: series with 24 standardised
values, categories with the number at the day's first hour. The fit of one meter, a year of days, runs in Python.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions import calendar as cal
from meterloom.models.clustering import cluster_profiles
from meterloom.models.robust import adaptive_weights
from meterloom.operators.cleaning import dealt


@dataclass(frozen=True)
class HourlySettings:
    """Default values of the model."""

    alpha: float = 0.0425
    l1_ratio: float = 0.5
    max_iter: int = 1000
    tol: float = 1e-4
    bin_width: float = 12.0
    edge_share: float = 0.0425
    min_daily_hours: int = 12
    clusters: int = 24
    reclusters: int = 3
    pca_share: float = 0.725
    seed: int = 0
    adaptive_passes: int = 0  # fits repeated with days weighed by their errors
    adaptive_tol: float = 1e-3
    cvrmse_threshold: float = 1.4
    pnrmse_threshold: float = 2.2
    scaler: str = "standard"  # or "robust": median and interquartile range
    extra_series: tuple[str, ...] = ()  # more columns by hour, such as has_pv; those that aren't there are passed over
    extra_categories: tuple[str, ...] = ()  # more numeric columns by day


def scale_of(x: np.ndarray, s: HourlySettings) -> tuple[float, float]:
    """(centre, scale) of all values."""
    if s.scaler == "standard":
        return float(x.mean()), float(x.std()) or 1.0
    if s.scaler != "robust":
        raise ValueError(f"no scaler {s.scaler!r}")
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75])
    return float(middle), float(high - low) or 1.0


def add_has_pv(hours: DataFrame, pv_start=None, key: str = "meter_id") -> DataFrame:
    """hours with has_pv: 1 from the date pv_start on (a date or a column), by default the meter's first."""
    day = F.to_date("ts")
    start = F.min(day).over(Window.partitionBy(key)) if pv_start is None else pv_start if isinstance(pv_start, Column) else F.lit(pv_start).cast("date")
    return hours.withColumn("has_pv", F.when(day >= start, 1.0).otherwise(0.0))


def elastic_net(x: np.ndarray, y: np.ndarray, s: HourlySettings, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients by target, intercepts): accelerated proximal gradient steps on the Gram matrix, all targets at once.

    Minimises |y - xb|^2 / 2n + alpha l1 |b|_1 + alpha (1 - l1) |b|^2 / 2, means taken out first. A step is
    one product of matrices, with x and its transpose in turn where days are fewer than half the features. Columns
    without variance have coefficients of 0. Steps end when no step moves a coefficient by more than a share of the largest,
    which leaves the distance to the minimum within tol of it (see optimality)."""
    xc, yc, mx, my = _centred(x, y, weights)
    varied = np.flatnonzero(np.ptp(x, axis=0) > 0)
    xc = xc[:, varied]
    q, few = xc.T @ yc, 2 * len(xc) < xc.shape[1]
    l1, l2 = s.alpha * s.l1_ratio, s.alpha * (1 - s.l1_ratio)
    if few:
        values = np.concatenate([[0.0], np.linalg.eigvalsh(xc @ xc.T)])
        back = np.ascontiguousarray(xc.T)
        product = lambda b: back @ (xc @ b)
    else:
        g = xc.T @ xc
        values = np.linalg.eigvalsh(g) if len(g) else np.zeros(1)
        product = lambda b: g @ b
    step = 1 / (max(float(values[-1]), 0.0) + l2 or 1.0)
    mu = max(float(values[0]), 0.0) + l2
    root = np.sqrt(mu * step)
    speed = (1 - root) / (1 + root)
    b = ahead = np.zeros((len(varied), y.shape[1]))
    for _ in range(20 * s.max_iter):
        z = (1 - step * l2) * ahead + step * (q - product(ahead))
        new = z - np.clip(z, -step * l1, step * l1)
        moved = float(np.abs(new - ahead).max(initial=0.0))
        ahead, b = new + speed * (new - b), new
        if moved <= s.tol * root * max(float(np.abs(b).max(initial=0.0)), 1e-12):
            break
    whole = np.zeros((x.shape[1], y.shape[1]))
    whole[varied] = b
    return whole.T, my - mx @ whole


def _centred(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """x and y less their weighted means, times the roots of the weights, and these means."""
    w = np.full(len(x), 1 / len(x)) if weights is None else weights / weights.sum()
    mx, my, root = w @ x, w @ y, np.sqrt(w)[:, None]
    return (x - mx) * root, (y - my) * root, mx, my


def optimality(x: np.ndarray, y: np.ndarray, coef: np.ndarray, s: HourlySettings, weights: np.ndarray | None = None) -> float:
    """How far the coefficients are from meeting the conditions of the minimum, 0 at the minimum itself:
    the gradient's distance from the penalty's slopes."""
    xc, yc, _, _ = _centred(x, y, weights)
    l1, l2 = s.alpha * s.l1_ratio, s.alpha * (1 - s.l1_ratio)
    b = coef.T
    slope = xc.T @ (yc - xc @ b) - l2 * b
    off = np.where(b != 0, np.abs(slope - l1 * np.sign(b)), np.maximum(np.abs(slope) - l1, 0))
    return float(off.max(initial=0.0))


def temperature_edges(t: np.ndarray, s: HourlySettings) -> np.ndarray:
    """Edges of bins of about one width between the outer bins, which hold a share of the rows each."""
    t = np.sort(t)
    low, high = t[min(int(np.ceil(len(t) * s.edge_share)), len(t) - 1)], t[max(int(np.floor(len(t) * (1 - s.edge_share))) - 1, 0)]
    if high <= low:
        return np.array([low])
    return np.linspace(low, high, max(2, int(np.ceil((high - low) / s.bin_width)) + 1))


def exponential_length(x: np.ndarray, y: np.ndarray) -> float:
    """k of y = a + b exp(x / k), from the integral of y, which is linear in y and x."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    area = np.concatenate([[0.0], np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(x))])
    dx, dy = x - x[0], y - y[0]
    a = np.array([[dx @ dx, dx @ area], [dx @ area, area @ area]])
    if np.linalg.cond(a) > 1e12:
        return np.inf
    rate = np.linalg.solve(a, np.array([dx @ dy, area @ dy]))[1]
    return float(1 / rate) if rate else np.inf


def edge_rate(t: np.ndarray, v: np.ndarray, edges: list[float], most: float = 5.0) -> float:
    """Mean length of the exponentials of use by temperature at each hour of day, those under `most`; else half of it."""
    x = 2 * (t - edges[0]) / max(edges[-1] - edges[0], 1e-9) - 1
    k = np.abs([exponential_length(x[:, h], v[:, h]) for h in range(24)])
    k = k[(k < most) & (k > 0.05)]
    return float(k.mean()) if len(k) else most / 2


def day_rows(days: pd.DataFrame, state: dict) -> np.ndarray:
    """Features of days: values by term and hour, then indicators of cluster and of the first hour's bin."""
    t = (np.stack(days["t"]) - state["t_mean"]) / state["t_std"]
    raw = np.stack(days["t"])
    bins = np.searchsorted(state["edges"], raw, "left")
    k = len(state["edges"]) + 1
    label = np.array([state["clusters"].get(f"{m}-{d}", -1) for m, d in zip(days["month"], days["dow"])])
    names = state["labels"]
    parts = [t * (bins == i) for i in range(k)] + [t * (label == c)[:, None] for c in names]
    x = 2 * (raw - state["edges"][0]) / max(state["edges"][-1] - state["edges"][0], 1e-9) - 1
    for sign, at in ((1, k - 1), (-1, 0)):
        parts.append(np.where(bins == at, np.expm1(np.clip(sign * x / state["rate"], -20, 20)), 0.0))
    if state["ghi"]:
        parts.append((np.stack(days["g"]) - state["g_mean"]) / state["g_std"])
    for c, (mean, std) in state["series"].items():
        parts.append((np.stack(days[f"x_{c}"]) - mean) / std)
    parts += [days[f"c_{c}"].to_numpy(float)[:, None] for c in state["categories"]]
    parts += [(label[:, None] == names).astype(float), (bins[:, :1] == np.arange(k)).astype(float)]
    return np.column_stack(parts)


def fit_meter(days: pd.DataFrame, s: HourlySettings, ghi: bool) -> dict:
    """days: t, v (and g, x_...) with 24 values each, c_..., month, dow, and n_good, the hours that weren't filled."""
    groups = days.groupby(["month", "dow"])["v"].apply(lambda v: np.stack(v).mean(0))
    label = cluster_profiles(np.stack(groups.to_numpy()), 2, s.clusters, s.reclusters, s.pca_share, 2, s.seed)
    t, v = np.stack(days["t"]), np.stack(days["v"])
    state = {"clusters": {f"{m}-{d}": int(c) for (m, d), c in zip(groups.index, label)}, "profiles": {f"{m}-{d}": p.tolist() for (m, d), p in groups.items()}, "labels": np.unique(label).tolist(), "edges": temperature_edges(t.ravel(), s).tolist(), "ghi": ghi}
    state |= dict(zip(("t_mean", "t_std", "v_mean", "v_std"), (*scale_of(t, s), *scale_of(v, s))))
    if ghi:
        state |= dict(zip(("g_mean", "g_std"), scale_of(np.stack(days["g"]), s)))
    state["series"] = {c: scale_of(np.stack(days[f"x_{c}"]), s) for c in s.extra_series if f"x_{c}" in days}
    state["categories"] = [c for c in s.extra_categories if f"c_{c}" in days]
    state["labels"] = np.array(state["labels"])
    state["rate"] = edge_rate(t, v, state["edges"])
    use = days[days["n_good"] >= s.min_daily_hours]
    x = day_rows(use, state)
    y = (np.stack(use["v"]) - state["v_mean"]) / state["v_std"]
    by_error = None
    coef, intercept = elastic_net(x, y, s)
    last = np.inf
    for _ in range(s.adaptive_passes):
        by_day = np.sqrt(((y - x @ coef.T - intercept) ** 2).mean(axis=1))
        if (last - by_day.mean()) / max(by_day.mean(), 1e-12) < s.adaptive_tol:
            break
        last = by_day.mean()
        by_error = adaptive_weights(by_day)[0]
        coef, intercept = elastic_net(x, y, s, by_error)
    gap = optimality(x, y, coef, s, by_error)
    p = (x @ coef.T + intercept) * state["v_std"] + state["v_mean"]
    resid = (np.stack(use["v"]) - p).ravel()
    n, k = resid.size, int((coef != 0).sum() + intercept.size)
    rmse = float(np.sqrt((resid**2).sum() / max(n - k, 1)))
    q = np.quantile(v, [0.25, 0.75])
    state |= {"labels": state["labels"].tolist(), "coef": coef.tolist(), "intercept": intercept.tolist(), "n": n, "parameters": k, "optimality": gap, "rmse": float(np.sqrt((resid**2).mean())), "cvrmse_adj": rmse / max(abs(float(v.mean())), 1e-9), "pnrmse_adj": rmse / max(float(q[1] - q[0]), 1e-9)}
    return state


def all_clusters(days: pd.DataFrame, state: dict) -> dict[str, int]:
    """Clusters by month and weekday, those of days that the fit lacked among them.

    These take the cluster of the nearest mean profile of the known ones among days, or if there are none
    of the fit's; without use (v) they take a neighbouring month's cluster."""
    known = dict(state["clusters"])
    name = days["month"].astype(str) + "-" + days["dow"].astype(str)
    missing = sorted(set(name) - set(known))
    if missing and "v" in days:
        v = np.stack(days["v"]).astype(float)
        whole = ~np.isnan(v).any(axis=1)
        profiles = {k: v[whole & (name == k).to_numpy()].mean(axis=0) for k in sorted(set(name[whole]))}
        near = {k: p for k, p in profiles.items() if k in known} or {k: np.array(p) for k, p in state["profiles"].items()}
        for k in set(missing) & set(profiles):
            known[k] = known[min(near, key=lambda x: (float(((near[x] - profiles[k]) ** 2).sum()), x))]
    for k in missing:
        if k not in known:
            m, d = map(int, k.split("-"))
            known[k] = known[min(state["clusters"], key=lambda x: (int(x.split("-")[1]) != d, min((int(x.split("-")[0]) - m) % 12, (m - int(x.split("-")[0])) % 12), x))]
    return known


def predict_meter(days: pd.DataFrame, state: dict) -> np.ndarray:
    """24 values a day."""
    state = state | {"clusters": all_clusters(days, state)}
    state = state | {"labels": np.array(state["labels"]), "edges": np.array(state["edges"])}
    return (day_rows(days, state) @ np.array(state["coef"]).T + np.array(state["intercept"])) * state["v_std"] + state["v_mean"]


class HourlyModel:
    """fit() gives a row a meter with its model as JSON; predict() gives hours."""

    def __init__(self, settings: HourlySettings | None = None):
        self.settings = settings or HourlySettings()

    def _days(self, hours: DataFrame, key: str, ghi: bool) -> DataFrame:
        def vector(c: str):
            by_hour = F.map_from_entries(F.collect_list(F.struct("_h", c)))
            return by_hour.alias(f"_{c}")

        flags = [c for c in hours.columns if c.startswith("interpolated_")]
        good = F.lit(True)
        for c in flags:
            good = good & ~F.coalesce(F.col(c), F.lit(False))
        values = ["temperature", *(["observed"] if "observed" in hours.columns else []), *(["ghi"] if ghi else [])]
        counted = values[-1]
        series, categories = ([c for c in wanted if c in hours.columns] for wanted in (self.settings.extra_series, self.settings.extra_categories))
        values += [c for c in series if c not in values]
        firsts = [F.min_by(F.col(c).cast("double"), F.when(F.col(c).isNotNull(), F.col("_h"))).alias(f"c_{c}") for c in categories]
        h = hours.groupBy(key, F.to_date("ts").alias("day"), F.hour("ts").alias("_h")).agg(*(F.avg(c).alias(c) for c in dict.fromkeys([*values, *categories])), F.min(good.cast("int")).alias("_good"))
        d = h.groupBy(key, "day").agg(*(vector(c) for c in values), F.sum(F.when(F.col(counted).isNotNull() & (F.col("_good") == 1), 1).otherwise(0)).alias("n_good"), F.count("temperature").alias("_n"), *firsts)
        every = F.sequence(F.lit(0), F.lit(23))

        def full(c: str):
            m = F.col(f"_{c}")
            at = F.transform(every, lambda i: F.coalesce(F.try_element_at(m, i), F.try_element_at(m, i - 1), F.try_element_at(m, i + 1)))
            return F.transform(at, lambda x: x)

        names = {"temperature": "t", "observed": "v", "ghi": "g"}
        out = d.select(key, "day", F.month("day").alias("month"), cal.weekday("day").alias("dow"), "n_good", *(full(c).alias(names.get(c, f"x_{c}")) for c in values), *(f"c_{c}" for c in categories))
        for c in out.columns:
            if c.startswith(("x_", "c_")):
                out = out.where(~F.exists(c, lambda x: x.isNull()) if c.startswith("x_") else F.col(c).isNotNull())
        return out

    def fit(self, hours: DataFrame, key: str = "meter_id") -> DataFrame:
        """hours: key, ts, temperature, observed (and ghi, interpolated_*, the settings' extra columns), one row an hour. Days with a gap left are
        not used; a meter without days has no row. ok tells whether the errors are under a threshold."""
        s, ghi = self.settings, "ghi" in hours.columns
        days = self._days(hours, key, ghi)
        days = days.where(~F.exists("t", lambda x: x.isNull()) & ~F.exists("v", lambda x: x.isNull()))
        kind = hours.schema[key].dataType.simpleString()

        def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("day")
            if (pdf["n_good"] >= s.min_daily_hours).sum() < 7:
                return pd.DataFrame(columns=[key, "model", "cvrmse_adj", "pnrmse_adj", "ok"])
            m = fit_meter(pdf, s, ghi)
            ok = m["cvrmse_adj"] < s.cvrmse_threshold or m["pnrmse_adj"] < s.pnrmse_threshold
            return pd.DataFrame([[group[0], json.dumps(m), m["cvrmse_adj"], m["pnrmse_adj"], ok]], columns=[key, "model", "cvrmse_adj", "pnrmse_adj", "ok"])

        return dealt(days, key).groupBy(key).applyInPandas(one, f"{key} {kind}, model string, cvrmse_adj double, pnrmse_adj double, ok boolean")

    def predict(self, models: DataFrame, hours: DataFrame, key: str = "meter_id") -> DataFrame:
        """hours with predicted. Both hours of a repeated one have its value; days with a temperature (or a value
        of an extra column) missing have none. observed, if there, is only used for months and weekdays that the fit lacked."""
        ghi = "ghi" in hours.columns
        days = self._days(hours, key, ghi).where(~F.exists("t", lambda x: x.isNull()))
        kind = hours.schema[key].dataType.simpleString()

        def one(group: tuple, pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(model):
                return pd.DataFrame(columns=[key, "day", "values"])
            p = predict_meter(pdf, json.loads(model["model"].iloc[0]))
            return pd.DataFrame({key: group[0], "day": pdf["day"], "values": list(p)})

        got = dealt(days, key).groupBy(key).cogroup(dealt(models.select(key, "model"), key).groupBy(key)).applyInPandas(one, f"{key} {kind}, day date, values array<double>")
        rows = hours.withColumns({"day": F.to_date("ts"), "_h": F.hour("ts")}).join(got, [key, "day"], "left")
        return rows.select(*hours.columns, F.try_element_at("values", F.col("_h") + 1).alias("predicted"))

    def describe(self) -> str:
        return json.dumps(asdict(self.settings))
