"""Temperature and calendar features: degree days, bins, segments, occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.calendar import hour_of_week
from meterloom.functions.scalar import bin_parts
from meterloom.operators.cleaning import KEY, in_order

#: The first bin edges in degrees Fahrenheit.
BIN_EDGES = [30, 45, 55, 65, 75, 90]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def degree_days(df: DataFrame, heating: list[float], cooling: list[float], t: str = "temperature", keys=KEY, day: str = "day", means: bool = True, least: float = 0.5) -> DataFrame:
    """Degree days of each meter and day from hourly temperatures: by the day's mean where more than
    `least` of 24 hours have one. With means=False the hourly degrees are summed over 24."""
    enough = F.count(t) > 24 * least
    mean = F.when(enough, F.avg(t))
    out = []
    for name, points, sign in (("hdd", heating, -1.0), ("cdd", cooling, 1.0)):
        for p in points:
            above = F.greatest((F.col(t) - float(p)) * sign, F.lit(0.0))
            c = F.greatest((mean - float(p)) * sign, F.lit(0.0)) if means else F.sum(F.when(F.col(t).isNotNull(), above)) / 24.0
            out.append(F.when(enough, c).alias(f"{name}_{p:g}"))
    return df.groupBy(*keys, day).agg(mean.alias("temperature_mean"), F.count(t).alias("hours_kept"), (F.count("*") - F.count(t)).alias("hours_dropped"), *out)


def period_degree_days(periods: DataFrame, days: DataFrame, columns: list[str], keys=KEY, start: str = "start", day: str = "day", least: float = 0.9, means: bool = True) -> DataFrame:
    """Degree days by reading period [start, next start): the mean day's, or that times all its days. A
    period with a temperature on less than `least` of its days, and a meter's last, have nulls.

    Days go to their period by one sorted window, not by a range join."""
    marks = periods.select(*keys, F.col(start).cast("date").alias("_d"), F.col(start).alias("_start"), *(F.lit(None).cast("double").alias(c) for c in columns))
    rows = days.select(*keys, F.col(day).cast("date").alias("_d"), F.lit(None).cast(marks.schema["_start"].dataType).alias("_start"), *(F.col(c).cast("double").alias(c) for c in columns))
    both = marks.withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_side", F.lit(1)))
    w = in_order(keys, "_d").orderBy("_d", "_side")
    both = both.withColumn("_p", F.last("_start", True).over(w)).where("_side = 1 and _p is not null")
    span = periods.select(*keys, F.col(start).alias("_p"), F.datediff(F.lead(start).over(in_order(keys, start)), F.col(start)).alias("n_days"))
    kept = F.count(columns[0])
    got = both.groupBy(*keys, "_p").agg(kept.alias("n_days_kept"), *(F.avg(c).alias(c) for c in columns))
    out = span.join(got, [*keys, "_p"], "left")
    ok = F.col("n_days").isNotNull() & (F.col("n_days_kept") >= least * F.col("n_days"))
    return out.select(*keys, F.col("_p").alias(start), "n_days", F.coalesce("n_days_kept", F.lit(0)).alias("n_days_kept"), (F.col("n_days") - F.coalesce("n_days_kept", F.lit(0))).alias("n_days_dropped"), *(F.when(ok, F.col(c) * (1 if means else F.col("n_days"))).alias(c) for c in columns))


def segment_weights(df: DataFrame, kind: str, ts: str = "ts", drop_zero: bool = False) -> DataFrame:
    """A row for each row of df and segment: segment and weight.

    Kinds: single, one_month, three_month, three_month_weighted (the months beside at one half)."""
    month = F.month(ts)
    if kind == "single":
        return df.withColumn("segment", F.lit("all")).withColumn("weight", F.lit(1.0))
    if kind not in ("one_month", "three_month", "three_month_weighted"):
        raise ValueError(f"unknown segment type {kind}")
    beside = {"one_month": 0.0, "three_month": 1.0, "three_month_weighted": 0.5}[kind]
    entries = []
    for i in range(12):
        name = MONTHS[i] if kind == "one_month" else "-".join(MONTHS[(i + k) % 12] for k in (-1, 0, 1)) + ("-weighted" if kind == "three_month_weighted" else "")
        gap = F.pmod(month - 1 - i, F.lit(12))
        entries.append(F.struct(F.lit(name).alias("segment"), F.when(gap == 0, 1.0).when(gap.isin(1, 11), beside).otherwise(0.0).alias("weight")))
    out = df.withColumn("_s", F.explode(F.array(*entries))).select(*df.columns, "_s.segment", "_s.weight")
    return out.where("weight > 0") if drop_zero else out


def missing_hours(df: DataFrame, keys=KEY, ts: str = "ts") -> DataFrame:
    """By meter the hours of the week without a reading, in order."""
    got = df.groupBy(*keys).agg(F.collect_set(hour_of_week(ts)).alias("_h"))
    return got.select(*keys, F.array_except(F.sequence(F.lit(0), F.lit(167)), "_h").alias("missing"))


def occupancy(df: DataFrame, keys=("meter_id", "segment"), value: str = "meter_value", share: float = 0.65) -> DataFrame:
    """(keys, hour_of_week, occupied): whether the residuals of use against degree days are positive in more
    than `share` of the hour's rows.

    df has value, hdd_50, cdd_65, weight and hour_of_week. The weighted least squares of three
    coefficients is solved from moments, so it is one aggregation."""
    x, y, v, w = F.col("cdd_65"), F.col("hdd_50"), F.col(value), F.col("weight")
    ok = v.isNotNull() & x.isNotNull() & y.isNotNull() & (w > 0)
    df = df.where(ok)
    terms = {"n": w, "x": w * x, "y": w * y, "xx": w * x * x, "xy": w * x * y, "yy": w * y * y, "v": w * v, "xv": w * x * v, "yv": w * y * v}
    m = df.groupBy(*keys).agg(*(F.sum(c).alias(f"_{k}") for k, c in terms.items()))
    c = {k: F.col(f"_{k}") for k in terms}
    sxx, syy, sxy = c["xx"] - c["x"] * c["x"] / c["n"], c["yy"] - c["y"] * c["y"] / c["n"], c["xy"] - c["x"] * c["y"] / c["n"]
    sxv, syv = c["xv"] - c["x"] * c["v"] / c["n"], c["yv"] - c["y"] * c["v"] / c["n"]
    det = sxx * syy - sxy * sxy
    small = F.abs(det) <= 1e-12 * F.greatest(F.abs(sxx * syy), F.lit(1e-300))
    bx = F.when(~small, (sxv * syy - syv * sxy) / det).when(sxx > syy, F.try_divide(sxv, sxx)).otherwise(F.lit(0.0))
    by = F.when(~small, (syv * sxx - sxv * sxy) / det).when(syy >= sxx, F.coalesce(F.try_divide(syv, syy), F.lit(0.0))).otherwise(F.lit(0.0))
    fit = m.select(*keys, bx.alias("_bx"), by.alias("_by"), ((c["v"] - bx * c["x"] - by * c["y"]) / c["n"]).alias("_b0"))
    resid = v - (F.col("_b0") + F.col("_bx") * x + F.col("_by") * y)
    seen = df.join(fit, list(keys)).groupBy(*keys, "hour_of_week").agg((F.avg((resid > 0).cast("double")) > share).alias("occupied"))
    # Hours never seen count as occupied.
    every = fit.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(167))).alias("hour_of_week"))
    return every.join(seen, [*keys, "hour_of_week"], "left").withColumn("occupied", F.coalesce("occupied", F.lit(True)))


def bin_counts(df: DataFrame, t: str = "temperature", keys=KEY, edges=BIN_EDGES) -> DataFrame:
    """Counts of temperatures in each bin, in order of bins."""
    low, high = [float("-inf"), *edges], [*edges, float("inf")]
    inside = [F.sum(((F.col(t) > float(a)) & (F.col(t) <= float(b))).cast("long")) for a, b in zip(low, high)]
    return df.where(F.col(t).isNotNull()).groupBy(*keys).agg(F.array(*inside).alias("counts"))


def fit_edges(counts: Column, edges=BIN_EDGES, least: int = 20) -> Column:
    """Edges left when bins of fewer than `least` rows join a neighbour.

    An outer bin that is too small loses its edge first; an inner bin loses its right edge, only when
    both outer bins are large enough; repeated until none is too small."""
    keep = F.array(*[F.struct(F.lit(float(e)).alias("edge"), counts[i].alias("n")) for i, e in enumerate(edges)])
    start = F.struct(keep.alias("bins"), counts[len(edges)].alias("top"))

    def step(s: Column, _: Column) -> Column:
        bins, top = s["bins"], s["top"]
        n = F.size(bins)
        first, last = F.try_element_at(bins, F.lit(1)), F.try_element_at(bins, F.lit(-1))
        bad_first, bad_top = (n > 0) & (first["n"] < least), (n > 0) & (top < least)

        def merged(i: Column) -> Column:  # drops edge i, its bin joins the next
            return F.transform(F.filter(bins, lambda b, k: k != i), lambda b, k: F.struct(b["edge"].alias("edge"), (b["n"] + F.when(k == i, F.element_at(bins, i + 1)["n"]).otherwise(0)).alias("n")))

        no_first = F.struct(merged(F.lit(0)).alias("bins"), (top + F.when(n == 1, first["n"]).otherwise(0)).alias("top"))
        no_last = F.struct(F.slice(bins, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("bins"), (top + F.coalesce(last["n"], F.lit(0))).alias("top"))
        small = F.array_position(F.transform(bins, lambda b: b["n"] < least), True) - 1
        at = small.cast("int")
        inner = F.struct(merged(at).alias("bins"), (top + F.when(at == n - 1, F.coalesce(last["n"], F.lit(0))).otherwise(0)).alias("top"))
        return F.when(bad_first, no_first).when(bad_top, no_last).when(small >= 0, inner).otherwise(s)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(len(edges))), start, step)
    return F.transform(done["bins"], lambda b: b["edge"])


def bin_features(df: DataFrame, edges: list[float], t: str = "temperature") -> DataFrame:
    return df.select("*", *(c.alias(f"bin_{i}") for i, c in enumerate(bin_parts(F.col(t), edges))))


def usage_per_day(df: DataFrame, value: str = "value", keys=KEY, ts: str = "ts") -> DataFrame:
    """Each reading over the days to the next; null on the last."""
    from meterloom.operators.cleaning import gap_days

    return gap_days(df, keys, ts, "_gap").withColumn("usage_per_day", F.col(value) / F.col("_gap")).drop("_gap")
