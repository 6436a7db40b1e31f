"""Models of hours, gap filling, overlap of seasons and alignment."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom.models import filling, overlap
from meterloom.models import hourly as hourly_module
from meterloom.models.hourly import HourlyModel, HourlySettings
from meterloom.models.segmented import DemandResponseModel, SegmentedModel, _edges, fit_segment
from meterloom.operators import alignment, features, periods


def hourly(spark, days=120, tz=None):
    rng = np.random.default_rng(0)
    start, rows = dt.datetime(2021, 1, 1), []
    for i in range(days * 24):
        ts = start + dt.timedelta(hours=i)
        t = 55 + 25 * np.sin(2 * np.pi * i / (24 * 120)) + 8 * np.sin(2 * np.pi * (ts.hour - 9) / 24)
        v = 5 + 0.3 * max(t - 65, 0) + 0.2 * max(50 - t, 0) + 2 * (9 <= ts.hour < 18) * (ts.weekday() < 5) + rng.normal(0, 0.1)
        rows.append(("m", ts, float(t), float(v)))
    return spark.createDataFrame(rows, "meter_id string, ts timestamp_ntz, temperature double, observed double")


def test_hourly_model(spark):
    h, m = hourly(spark), HourlyModel()
    models = m.fit(h)
    assert models.first().ok
    p = m.predict(models, h.drop("observed").withColumn("ghi_free", F.lit(1))).join(h, ["meter_id", "ts"])
    e = p.agg(F.sqrt(F.avg((F.col("predicted") - F.col("observed")) ** 2)), F.count("predicted")).first()
    assert e[0] < 0.6 and e[1] == 120 * 24
    assert m.fit(h.limit(0)).count() == 0


def test_hourly_extra_columns(spark):
    h = hourly_module.add_has_pv(hourly(spark), dt.date(2021, 3, 1)).withColumn("visit", (F.dayofyear("ts") % 3 == 0).cast("int"))
    assert {r.has_pv for r in h.where("ts < '2021-03-01'").collect()} == {0.0} and {r.has_pv for r in hourly_module.add_has_pv(h).collect()} == {1.0}
    h = h.withColumn("observed", F.col("observed") - 3 * F.col("has_pv") + 2 * F.col("visit"))

    def error(**more):
        m = HourlyModel(HourlySettings(**more))
        e = m.predict(m.fit(h), h).agg(F.sqrt(F.avg((F.col("predicted") - F.col("observed")) ** 2)), F.count("predicted")).first()
        assert e[1] == 120 * 24
        return e[0]

    plain, pv, both = error(), error(extra_series=("has_pv", "absent")), error(extra_series=("has_pv",), extra_categories=("visit",))
    assert pv < plain - 0.01 and both < 0.8 * pv
    assert error(extra_series=("has_pv",), extra_categories=("visit",), scaler="robust") < 0.8 * pv


def test_hourly_scalers():
    x = np.array([0.0, 1, 2, 3, 100])
    assert hourly_module.scale_of(x, HourlySettings(scaler="robust")) == (2.0, 2.0)
    assert hourly_module.scale_of(x, HourlySettings()) == pytest.approx((x.mean(), x.std()))


def test_hourly_nearest_profile():
    low, high = np.full(24, 1.0), np.full(24, 9.0)
    state = {"clusters": {"1-0": 0, "1-5": 1}, "profiles": {"1-0": low.tolist(), "1-5": high.tolist()}}
    days = pd.DataFrame({"month": [1, 1, 7, 7], "dow": [0, 5, 0, 5], "v": [low, high, high - 1, low + 1]})
    assert hourly_module.all_clusters(days, state) == {"1-0": 0, "1-5": 1, "7-0": 1, "7-5": 0}
    assert hourly_module.all_clusters(days[2:], state) == {"1-0": 0, "1-5": 1, "7-0": 1, "7-5": 0}
    assert hourly_module.all_clusters(days.drop(columns="v"), state) == {"1-0": 0, "1-5": 1, "7-0": 0, "7-5": 1}


def test_exponential_length_and_day_weights():
    x = np.linspace(-1, 1, 200)
    assert hourly_module.exponential_length(x, 3 + 2 * np.exp(x / 0.7)) == pytest.approx(0.7, rel=0.01)
    rng = np.random.default_rng(0)
    a, s = rng.normal(size=(100, 3)), HourlySettings(alpha=1e-4)
    y = (a @ np.array([1.0, 2, 3]))[:, None] + 5
    y[:5] += 50
    w = np.r_[np.zeros(5), np.ones(95)]
    b, c = hourly_module.elastic_net(a, y, s, w)
    assert np.allclose(b[0], [1, 2, 3], atol=0.01) and c[0] == pytest.approx(5, abs=0.01)


def test_segmented_model(spark):
    h, m = hourly(spark), SegmentedModel()
    params = m.fit(h)
    assert params.count() == 6  # January to April, and what weighs December and May
    p = m.predict(params, h)
    e = p.agg(F.sqrt(F.avg((F.col("predicted") - F.col("observed")) ** 2)), F.count("predicted")).first()
    assert e[0] < 0.4 and e[1] == 120 * 24
    u = m.monthly_uncertainty(params, p).collect()
    assert len(u) == 4 and all(x.uncertainty > 0 for x in u)
    dr = DemandResponseModel()
    assert dr.predict(dr.fit(h), h).where("predicted is null").count() == 0


def test_segment_by_hand():
    rng = np.random.default_rng(1)
    hour, t = np.arange(168 * 8) % 168, rng.uniform(20, 90, 168 * 8)
    v = hour * 0.01 + 0.5 * t
    got = fit_segment(hour, t, v, np.ones(len(t)))
    assert got["mse"] == pytest.approx(0, abs=1e-12)
    assert np.allclose(got["occupied_slopes"], 0.5, atol=1e-6) or np.allclose(got["empty_slopes"], 0.5, atol=1e-6)
    assert len(_edges(np.full(100, 60.0), 20)) == 0


def test_lag_fill(spark):
    x = np.tile(np.sin(np.arange(24) / 24 * 2 * np.pi), 30)
    y = x.copy()
    y[[100, 101, 102, 300, 500]] = np.nan
    assert np.allclose(filling.fill_by_lags(y, 25, 6), x, atol=0.3)
    assert filling.autocorrelation(x, 25)[23] > 0.95
    rows = [("m", dt.datetime(2021, 1, 1) + dt.timedelta(hours=i), None if np.isnan(v) else float(v)) for i, v in enumerate(y)]
    out = filling.fill(spark.createDataFrame(rows, "meter_id string, ts timestamp_ntz, value double"), "value")
    got = {r.ts: (r.value, r.interpolated_value) for r in out.collect()}
    assert sum(f for _, f in got.values()) == 5 and all(v is not None for v, _ in got.values())


def test_bands_and_frames():
    x = np.linspace(0, 1, 400)
    y = np.random.default_rng(0).normal(size=400) * (1 + x)
    low, high = filling.rolling_band(x, y, window=0.2)
    assert high[-1] - low[-1] > high[0] - low[0] > 0
    assert filling.frames(np.arange(5), 3).shape == (3, 3)
    with pytest.raises(ValueError):
        filling.frames(np.arange(2), 3)
    assert filling.median_of_five(np.array([1.0, 9, 2, 3, 2])).tolist() == [2.0, 2.0, 2.0, 2.0, 2.0]


def test_overlap():
    rng = np.random.default_rng(0)
    a = overlap.ellipse(rng.normal(0, 1, 200), rng.normal(0, 1, 200))
    b = overlap.ellipse(rng.normal(1, 1, 200), rng.normal(0, 1, 200))
    c = overlap.ellipse(rng.normal(30, 1, 200), rng.normal(0, 1, 200))
    assert overlap.overlap(a, b) and not overlap.overlap(a, c)
    assert overlap.ellipse(np.zeros(2), np.zeros(2)) is None


def test_alignment(spark):
    day = lambda i: dt.datetime(2021, 1, 1) + dt.timedelta(days=i)
    meter = spark.createDataFrame([("m", day(i), None if i in (0, 9) else 1.0) for i in range(10)], "meter_id string, ts timestamp_ntz, value double")
    temp = spark.createDataFrame([("m", day(3) + dt.timedelta(hours=i), 50.0) for i in range(24 * 10)], "meter_id string, ts timestamp_ntz, temperature double")
    out = alignment.align_series(meter, temp)
    got = out.agg(F.min("ts"), F.max("ts"), F.count("value")).first()
    assert got[0] == day(3) and got[1] == day(8) + dt.timedelta(hours=23) and got[2] == 6
    cover = alignment.temperature_coverage(temp.where("hour(ts) < 10 or day(ts) > 6"), spark.createDataFrame([("m", day(i)) for i in (3, 4, 5, 6)], "meter_id string, start timestamp_ntz"))
    assert cover.count() == 4


def test_period_degree_days(spark):
    days = spark.createDataFrame([("m", dt.date(2021, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40)], "meter_id string, day date, hdd double")
    p = spark.createDataFrame([("m", dt.date(2021, 1, 1)), ("m", dt.date(2021, 1, 11)), ("m", dt.date(2021, 2, 5))], "meter_id string, start date")
    out = features.period_degree_days(p, days, ["hdd"]).orderBy("start").collect()
    assert [(r.n_days, r.hdd) for r in out] == [(10, 4.5), (25, 22.0), (None, None)]
    total = features.period_degree_days(p, days, ["hdd"], means=False).orderBy("start").first()
    assert total.hdd == 45.0


def test_overshoot(spark):
    reads = spark.createDataFrame([("m", dt.datetime(2020, 1, 1) + dt.timedelta(days=30 * i), float(i)) for i in range(20)], "meter_id string, ts timestamp_ntz, value double")
    out = periods.baseline(reads, overshoot=True)
    assert out.count() == 13 and out.where("value is null").count() == 1
    with pytest.raises(ValueError):
        periods.terms(reads, [30], ["a"], method="other").count()
    assert periods.terms(reads, [60, 60], ["a", "b"], method="nearest").where("complete").count() == 2
