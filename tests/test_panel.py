"""Queries against their SQL on small tables, models against known values, and edge cases."""

import datetime as dt
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meterloom import settings
from meterloom.functions import calendar, scalar, stats
from meterloom.models import clustering, robust
from meterloom.models.daily import Settings, all_splits, choose, fit_block
from meterloom.models.hourly import HourlySettings, elastic_net
from meterloom.operators import cleaning, features, metrics, periods, resample, sufficiency
from meterloom.plans import queries
from meterloom.sources import readers

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
have_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(rows, names):
    def one(v):
        return "nan" if isinstance(v, float) and v != v else round(v, 8) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(one(r[n]) for n in names) for r in rows), key=repr)


@have_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = duck.execute(queries.ORACLES[name])
    names = sorted(c[0] for c in got.description)
    assert sorted(df.columns) == names
    want = [dict(zip([c[0] for c in got.description], r)) for r in got.fetchall()]
    assert _plain([r.asDict() for r in df.collect()], names) == _plain(want, names)


@have_data
def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def at(*x):
    return dt.datetime(*x)


def test_spread_keeps_the_sum_and_nulls(spark):
    df = rows(spark, [("a", at(2020, 1, 1, 12), 48.0), ("a", at(2020, 1, 3, 12), None), ("a", at(2020, 1, 5), 7.0)], "meter_id string, ts timestamp_ntz, value double")
    out = {r.ts.day: (r.value, r.coverage) for r in resample.spread(df, "day", coverage=True).collect()}
    assert out == {1: (12.0, 0.5), 2: (24.0, 1.0), 3: (12.0, 0.5), 4: (None, 0.0)}


def test_empty_tables(spark):
    df = rows(spark, [], "meter_id string, ts timestamp_ntz, value double")
    for out in (resample.spread(df), resample.on_spine(df), resample.interpolate(df, "value"), cleaning.granularity(df), periods.baseline(df), features.missing_hours(df)):
        assert out.count() == 0


def test_estimated_goes_one_read_on(spark):
    data = [("a", at(2020, 1, d), float(d), e) for d, e in ((1, True), (2, True), (3, False), (4, False), (5, True))]
    out = cleaning.roll_up_estimated(rows(spark, data, "meter_id string, ts timestamp_ntz, value double, estimated boolean"))
    assert [(r.ts.day, r.value) for r in out.orderBy("ts").collect()] == [(3, 5.0), (4, 4.0), (5, 5.0)]


def test_interpolation_and_first_reads(spark):
    data = [("a", at(2020, 1, 1, h), v, i) for i, (h, v) in enumerate(((0, 1.0), (0, 9.0), (1, None), (3, 4.0), (4, None)))]
    df = cleaning.first_reads(rows(spark, data, "meter_id string, ts timestamp_ntz, value double, i int"), "i")
    out = resample.interpolate(df, "value").orderBy("ts").collect()
    assert [(r.value, r.interpolated) for r in out] == [(1.0, False), (2.0, True), (4.0, False), (4.0, True)]


def test_time_zones(spark):
    df = rows(spark, [(at(2020, 3, 8, 7),), (at(2020, 11, 1, 5),)], "ts timestamp_ntz").select(calendar.local_time("ts", "America/New_York").alias("l"))
    assert [r.l for r in df.collect()] == [at(2020, 3, 8, 3), at(2020, 11, 1, 1)]


def test_days_of_23_and_25_hours(spark):
    h = spark.range(0, 24 * 366).select(F.lit("a").alias("meter_id"), F.expr("timestamp_ntz'2020-01-01 05:00:00' + make_dt_interval(0, cast(id as int))").alias("u"), F.col("id").cast("double").alias("value"))
    h = h.withColumn("ts", calendar.local_time("u", "America/New_York"))
    odd = {(r.day.isoformat(), r.rows) for r in resample.short_and_long_days(h).collect()}
    assert odd == {("2020-03-08", 23), ("2020-11-01", 25)}
    v = {r.day.isoformat(): r["values"] for r in resample.day_vectors(h, "value").collect()}
    assert all(len(x) == 24 for x in v.values())
    day = v["2020-03-08"]
    assert day[2] == (day[1] + day[3]) / 2


def test_response_swaps_and_smooths(spark):
    def at_t(t, **p):
        base = dict(hdd_bp=50.0, hdd_beta=2.0, hdd_k=0.0, cdd_bp=70.0, cdd_beta=3.0, cdd_k=0.0, intercept=10.0, t_min=0.0, t_max=100.0) | p
        return spark.range(1).select(scalar.response(F.lit(float(t)), {k: F.lit(float(v)) for k, v in base.items()}).alias("y")).first().y

    assert (at_t(40), at_t(60), at_t(80)) == (30.0, 10.0, 40.0)
    assert at_t(40, hdd_bp=70, hdd_beta=3, cdd_bp=50, cdd_beta=2) == 30.0
    assert at_t(40, hdd_beta=0, cdd_beta=0) == 10.0
    assert at_t(40, hdd_k=5) == pytest.approx(30 + 10 * (math.exp(-2) - 1))


def test_bins(spark):
    df = rows(spark, [("a", float(t)) for t in range(0, 100)], "meter_id string, temperature double")
    counts = features.bin_counts(df)
    edges = counts.select(features.fit_edges(F.col("counts")).alias("e")).first().e
    assert counts.first().counts == [31, 15, 10, 10, 10, 15, 9]
    assert all(n >= 20 for n in np.bincount(np.searchsorted(edges, np.arange(100), "left")))


def test_t_quantile():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert stats.t_quantile(0.95, 1) == pytest.approx(6.313751515, abs=1e-7)
    assert stats.t_quantile(0.05, 30) == pytest.approx(-1.697260887, abs=1e-7)


def test_robust_weights():
    x = np.concatenate([np.zeros(50), np.random.default_rng(0).normal(size=200), [60.0]])
    w, _, shape = robust.adaptive_weights(x)
    assert w[-1] < 0.3 and shape < 2
    assert robust.log_partition(2.0) == pytest.approx(math.log(math.sqrt(2 * math.pi)), abs=1e-6)
    assert list(robust.fence(np.array([1.0, 2, 3, 4, 5]))) == pytest.approx([2 - 2 * 1.7239, 4 + 2 * 1.7239])


def test_shapes():
    assert [robust.shape_at(s) for s in (-1, 0, 1, 2)] == [-100, -100, pytest.approx(2), pytest.approx(2)]
    u = 10 ** (3 * 0.2**0.25)
    assert robust.shape_at(0.2) == pytest.approx(-100 + 102 * (1 - 2 / (1 + u)) / (1 - 2 / 1001))
    assert [robust.shape_at(s, 3.0) for s in (0, 0.5, 1)] == [-100, 1, 100]


def test_order_line_and_scale(spark):
    df = rows(spark, [("a", 1.0, 5.0), ("a", 1.0, 7.0), ("b", None, 1.0), ("c", 0.0, 1.0), ("c", 2.0, 5.0)], "k string, x double, y double")
    out = {r.k: r for r in df.groupBy("k").agg(*(c.alias(n) for n, c in stats.line(F.col("y"), F.col("x")).items()), stats.kth(F.col("y"), 2).alias("second"), stats.arg_min(F.col("y"), F.col("x"), F.col("y")).alias("least")).collect()}
    assert [(r.slope, r.intercept, r.second, r.least) for r in (out["a"], out["b"], out["c"])] == [(0.0, 6.0, 7.0, 5.0), (None, None, None, None), (2.0, 1.0, 5.0, 1.0)]
    assert sorted(r.x is None or r.x for r in stats.min_max(df, ["k"], "x", 0.0).collect()) == [0.0, 0.5, 0.5, 1.0, True]


def test_rules_of_classes(spark):
    start = at(2020, 1, 1)
    df = rows(spark, [("a", start + dt.timedelta(days=i), 1.0, None if i % 2 else 1.0, 24, 0) for i in range(365)] + [("b", start, None, None, 0, 24)], "meter_id string, ts timestamp_ntz, observed double, ghi double, temperature_not_null int, temperature_null int")
    got = {(r.meter_id, kind, model): {x.qualified_name.split(".")[-1] for x in r.disqualification} for model in ("daily", "hourly") for kind in ("baseline", "reporting") for r in sufficiency.judge(sufficiency.statistics(df), kind, model=model).collect()}
    assert got["a", "baseline", "daily"] == got["a", "reporting", "daily"] == set()
    assert got["a", "baseline", "hourly"] == got["a", "reporting", "hourly"] == {"missing_monthly_ghi_data"}
    assert {"no_data", "too_many_days_with_missing_data", "too_many_days_with_missing_meter_data"} < got["b", "baseline", "daily"]
    log = {r.rule.split(".")[-1]: r.meters for r in sufficiency.report(sufficiency.judge(sufficiency.statistics(df))).collect()}
    assert log["no_data"] == 1


def test_splits():
    x = all_splits()
    assert len(x) == 48 and x[0] == "fw-su_sh_wi" and x[-1] == "wd-su__wd-sh__wd-wi__we-su__we-sh__we-wi"
    assert len({p for s in x for p in s.split("__")}) == 21


def test_change_points_are_found():
    rng = np.random.default_rng(1)
    t = rng.uniform(10, 95, 365)
    y = 20 + 1.5 * np.maximum(50 - t, 0) + 2.5 * np.maximum(t - 70, 0) + rng.normal(0, 1, 365)
    f = fit_block(t, y, Settings(smooth=False))
    assert (f.hdd_bp, f.cdd_bp) == (pytest.approx(50, abs=2), pytest.approx(70, abs=2))
    assert (f.hdd_beta, f.cdd_beta, f.intercept) == (pytest.approx(1.5, abs=0.1), pytest.approx(2.5, abs=0.15), pytest.approx(20, abs=0.6))
    day = np.where(np.arange(365) % 7 >= 5, "weekend", "weekday")
    season = np.array([calendar.SEASONS[min(i // 31, 11)] for i in range(365)])
    y2 = y + np.where(day == "weekend", 30, 0)
    assert choose(t, y2, season, day, Settings(smooth=False))[0] == "wd-su_sh_wi__we-su_sh_wi"


def test_elastic_net_against_its_conditions():
    rng = np.random.default_rng(2)
    x, s = rng.normal(size=(200, 6)), HourlySettings(alpha=0.1, l1_ratio=0.5, tol=1e-10)
    y = (x @ np.array([1.0, 0, 0, -2, 0, 0]) + 3 + rng.normal(0, 0.1, 200))[:, None]
    b, c = elastic_net(x, y, s)
    resid = y[:, 0] - x @ b[0] - c
    gradient = -(x - x.mean(0)).T @ resid / 200 + 0.05 * b[0]
    assert np.allclose(gradient[b[0] != 0], -0.05 * np.sign(b[0][b[0] != 0]), atol=1e-6)
    assert (np.abs(gradient[b[0] == 0]) <= 0.05 + 1e-6).all()


def test_clusters():
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 0.1, (20, 24)), rng.normal(5, 0.1, (30, 24)) * np.linspace(0, 1, 24)])
    label = clustering.cluster_profiles(p, 2, 6)
    assert len(set(label[:20])) == 1 and len(set(label[20:])) == 1 and label[0] != label[-1]
    assert np.allclose((clustering.haar(p) ** 2).sum(1)[:1], (p[0] ** 2).sum(), rtol=0.2)


def test_sufficiency_names(spark):
    df = rows(spark, [("a", at(2020, 1, 1) + dt.timedelta(days=i), -1.0 if i == 3 else 1.0, 24, 0) for i in range(300)], "meter_id string, ts timestamp_ntz, observed double, temperature_not_null int, temperature_null int")
    out = sufficiency.judge(sufficiency.statistics(df), electricity=False).first()
    assert {x.qualified_name.split(".")[-1] for x in out.disqualification} == {"negative_meter_values", "incorrect_number_of_total_days"}
    assert sufficiency.status(sufficiency.statistics(df)).first().status == "FAIL"


def test_metrics_of_a_perfect_fit(spark):
    df = rows(spark, [("a", at(2020, 1, 1 + i), float(i), float(i)) for i in range(10)], "meter_id string, ts timestamp_ntz, observed double, predicted double")
    m = metrics.fit_metrics(df, 1).first()
    assert (m.n, m.rmse, m.mae, m.r_squared) == (10, 0.0, 0.0, pytest.approx(1.0))


def test_sources(spark, tmp_path):
    (tmp_path / "m1.csv").write_text("start,value\n2020-01-01T00:00:00Z,1.5\n2020-01-01T00:30:00Z,2\n2020-01-01T01:00:00Z,\n")
    df = readers.meter_csv(spark, str(tmp_path / "m1.csv"), frequency="hourly")
    assert [(r.meter_id, r.ts.hour, r.value) for r in df.orderBy("ts").collect()] == [("m1", 0, 3.5), ("m1", 1, None)]
    readers.write_csv(df, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2
    text = rows(spark, [("x", '[{"start": "2020-01-01T00:00:00Z", "value": "1.0", "estimated": true}, {"start": "2020-01-02T00:00:00Z", "value": "bad", "estimated": null}]')], "meter_id string, j string")
    assert [(r.value, r.estimated) for r in readers.meter_json(text, "j", orient="records").orderBy("ts").collect()] == [(1.0, True), (None, False)]
    assert readers.meter_json(rows(spark, [("x", '[["2020-01-01T00:00:00Z", 2]]')], "meter_id string, j string"), "j").first().value == 2.0


def test_settings_and_serialization(spark):
    s = settings.make(Settings, developer=True, segment_minimum=8)
    assert s.segment_minimum == 8
    with pytest.raises(ValueError):
        settings.make(Settings, nothing=1)
    legacy = settings.import_legacy(spark, [("m", {"model_type": "cdd_hdd", "model_params": {"intercept": 1.0, "beta_hdd": 2.0, "heating_balance_point": 50, "beta_cdd": 3.0, "cooling_balance_point": 70}})])
    from meterloom.models.daily import PARAMS, DailyModel

    back = settings.params_from_json(settings.params_to_json(legacy, settings=s), PARAMS).drop("f_unc")
    assert back.first().asDict() == legacy.drop("f_unc").first().asDict()
    days = rows(spark, [("m", at(2020, 1, 1), 40.0), ("m", at(2020, 7, 1), 80.0)], "meter_id string, ts timestamp_ntz, temperature double")
    assert [r.predicted for r in DailyModel().predict(legacy, days).orderBy("ts").collect()] == [21.0, 31.0]


def test_streaming(spark, tmp_path):
    from meterloom.streaming import live

    data = [("a", at(2020, 1, 1, h), float(h), h == 1) for h in range(4)]
    rows(spark, data, "meter_id string, ts timestamp, value double, estimated boolean").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("meter_id string, ts timestamp, value double, estimated boolean").parquet(f"file://{tmp_path}/in")
    q = live.hourly_use(stream).writeStream.outputMode("complete").format("memory").queryName("use").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(value) s from use").first().s == 6.0
    q = live.roll_up_estimated(stream).writeStream.outputMode("append").format("memory").queryName("rolled").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.sql("select value from rolled").collect()) == [0.0, 3.0, 3.0]
