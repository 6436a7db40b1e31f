"""Fits do no work that their result doesn't need, and give the same result."""

import datetime as dt
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.functions import stats
from meterloom.models import daily, hourly, undivided
from meterloom.operators import resample
from meterloom.plans import queries


def test_undivided_fit_compares_no_seasons(monkeypatch):
    """Without splits no season has to be told from the others."""
    monkeypatch.setattr(daily, "separate_seasons", lambda *a: pytest.fail("seasons compared"))
    rng = np.random.default_rng(1)
    season, kind = rng.choice(["summer", "shoulder", "winter"], 365), rng.choice(["weekday", "weekend"], 365)
    t = rng.uniform(20, 90, 365)
    assert daily.allowed_splits(season, kind, daily.Settings.legacy(), t, t) == ["fw-su_sh_wi"]


def test_t_quantile_in_few_steps(monkeypatch):
    calls, known = [], stats.incomplete_beta
    monkeypatch.setattr(stats, "incomplete_beta", lambda *a: calls.append(a) or known(*a))
    for df, want in ((1.0, 6.313751514675043), (10.0, 1.8124611228107335)):
        assert stats.t_quantile(0.95, df) == pytest.approx(want, rel=1e-6)
    assert len(calls) < 60
    t = stats.t_quantile(0.95, 300.5)
    assert 1 - 0.5 * known(150.25, 0.5, 300.5 / (300.5 + t * t)) == pytest.approx(0.95, abs=1e-13)


def test_elastic_net_of_few_days(monkeypatch):
    """With fewer days than half the features no matrix of features by features is made; the minimum's conditions hold."""
    sizes, known = [], np.linalg.eigvalsh
    monkeypatch.setattr(np.linalg, "eigvalsh", lambda a: sizes.append(len(a)) or known(a))
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 200)), rng.normal(size=(30, 24))
    x[:, 5] = 3.0
    s = hourly.HourlySettings(tol=1e-7)
    b, c = hourly.elastic_net(x, y, s)
    assert sizes == [30] and b.shape == (24, 200) and (b[:, 5] == 0).all()
    assert hourly.optimality(x, y, b, s) < 1e-6


def test_spread_during(spark):
    rows = [(m, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), float(v)) for m, h, v in ((1, 5, 3), (1, 100, 7), (1, 1000, 2), (1, 1003, 5), (1, 3000, 1), (2, 0, 4), (2, 4000, 1))]
    df = spark.createDataFrame(rows, "meter_id long, ts timestamp_ntz, value double")
    for step in ("day", "hour"):
        want = resample.spread(df, step).where(F.col("ts").cast("date").between(F.lit("2020-02-10").cast("date"), F.lit("2020-02-20").cast("date")))
        got = resample.spread(df, step, during=("2020-02-10", "2020-02-20"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_spread_runs(spark):
    """The same days as runs of one value."""
    rows = [(m, dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * m + h), float(v)) for m in range(40) for h, v in ((5, 3), (100, 7), (1000, 2), (1003, 5), (1005, 5), (3000, 1))]
    rows += [(None, dt.datetime(2020, 1, 1), 1.0), (None, dt.datetime(2020, 1, 4), 1.0), (50, dt.datetime(2020, 1, 9), None), (50, dt.datetime(2020, 2, 4), 1.0)]
    df = spark.createDataFrame(rows, "meter_id long, ts timestamp_ntz, value double")
    for during in (None, ("2020-01-20", "2020-02-20")):
        runs = resample.spread_runs(df, during=during)
        got = runs.select("meter_id", F.explode(F.sequence("first", "last")).alias("ts"), "value").withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()
        assert sorted(map(str, got)) == sorted(map(str, resample.spread(df, during=during).collect())) and len(got) > 5 * runs.count()


START = dt.date(2019, 12, 29)


def _weather(spark):
    """Temperatures of 400 days, some of them odd; the last ten days are missing."""
    odd = {7: None, 8: math.nan, 9: 400.0, 10: -200.0}
    t = [odd.get(i, float(round(55 + 30 * math.sin(2 * math.pi * i / 365) + (i * 37 % 23 - 11) * 0.5))) for i in range(390)]
    return t, spark.createDataFrame([(START + dt.timedelta(days=i), x) for i, x in enumerate(t)], "day date, temperature double")


def _runs(spark):
    """Runs of days of 24 meters of several lengths, and odd ones."""
    rng, rows, t = np.random.default_rng(3), [], _weather(spark)[0]

    def add(m, a, b, use):
        rows.append((m, START + dt.timedelta(days=a), START + dt.timedelta(days=b), use))

    for m in range(24):
        at, end = 0, (400, 365, 90, 31, 19, 3, 2, 1)[m % 8]
        while at < end:
            to = min(at + int(rng.integers(0, 4)), end - 1)
            here = [x for x in t[at : to + 1] if x is not None and x == x and 0 < x < 100] or [50.0]
            add(f"m{m}", at, to, None if rng.random() < 0.03 else 4.0 if m == 9 else float(10 + (m % 3) * max(np.mean(here) - 65, 0) + (m % 2) * max(45 - np.mean(here), 0) + rng.normal(0, 1)))
            at = to + 1
    for i in range(60):
        add("nan", i, i, math.nan if i == 30 else 3.0 + max((t[i] or 0) - 40, 0) if i not in (8, 9, 10) else None)
        add(None, i, i, 3.0 + i % 7)
    add("void", 0, 1, None)
    add("none", 5, 4, 1.0)
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(x) for x in rows], "meter_id string, first date, last date, value double").repartition(3)


@pytest.mark.parametrize("together", [1, 500, 10**6])
def test_fit_months(spark, monkeypatch, together):
    """All meters at once give what fits one by one and the join with their coefficients give, however runs fall into batches."""
    m, runs, weather = daily.BillingModel(), _runs(spark).cache(), _weather(spark)[1]
    days = runs.where("first <= last").select("meter_id", F.explode(F.sequence("first", "last")).alias("day"), F.col("value").alias("observed"))
    days = days.join(weather, "day", "left").withColumn("ts", F.col("day").cast("timestamp_ntz")).cache()
    want = {(x.meter_id, str(x.month)): (x.observed, x.predicted) for x in m.predict_months(m.fit(days), days, 2).collect()}
    monkeypatch.setattr(undivided, "DAYS", together)
    sent = runs.where("first <= last").orderBy("meter_id", F.rand(1)).toArrow()
    known = undivided.Weather(weather.select(F.unix_date("day"), "temperature").collect())
    batches = undivided.months_of_meters(iter(sent.to_batches(max_chunksize=100)), known, 2, m.settings)
    for found in ([x for b in batches for x in b.to_pylist()], [x.asDict() for x in m.fit_months(runs, weather, 2).collect()]):
        got = {(x["meter_id"], str(x["month"])): (x["observed"], x["predicted"]) for x in found}
        assert len(found) == len(got) and set(got) == set(want)
        for k, pair in want.items():
            for a, b in zip(got[k], pair):
                assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, nan_ok=True)), k
    assert want["void", "2019-12-01"] == (None, None) and any(math.isnan(p) for _, p in want.values() if p is not None)


def test_fit_months_by_other_settings(spark):
    m, runs = daily.BillingModel(daily.Settings(split=False)), _runs(spark).where("meter_id in ('m2', 'm3')")
    assert m.fit_months(runs, _weather(spark)[1]).count() == 6
    with pytest.raises(ValueError, match="more than one"):
        undivided.Weather([(1, 2.0), (1, 3.0)])


def test_many_fits_in_little_time():
    """Two thousand meters take less time than some hundred did one by one (7 ms each)."""
    rng = np.random.default_rng(4)
    t, y = np.tile(rng.uniform(20, 90, 365), (2000, 1)), rng.uniform(0, 1e4, (2000, 365))
    began = time.process_time()
    f = undivided.fit_many(t, y, np.full(2000, 365), daily.Settings.legacy())
    assert time.process_time() - began < 4
    one = daily.fit_block(t[7], y[7], daily.Settings.legacy())
    assert [f[c][7] for c in f] == pytest.approx([getattr(one, c) for c in f], rel=1e-9)


def test_billing_days_are_not_moved(spark, capsys):
    """billing_fit gives its fits a row or two for each bill; no row for a day is shuffled, sorted, joined or sent."""
    queries.billing_fit(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "explode(sequence(" not in plan and "FlatMapGroups" not in plan and "Join" not in plan
