"""Time spines, spreading and summing of readings, and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions.calendar import seconds, wall
from meterloom.operators.cleaning import KEY, dealt, in_order

STEPS = {"hour": "interval 1 hour", "day": "interval 1 day", "month": "interval 1 month"}


def bucket(ts: str | Column, step: str) -> Column:
    return F.date_trunc(step, wall(ts)).cast("timestamp_ntz")


def spine(df: DataFrame, step: str = "hour", keys=KEY, ts: str = "ts") -> DataFrame:
    """Every step from the start of each meter's first day to the end of its last."""
    first, last = F.min(bucket(ts, "day")), F.max(bucket(ts, "day"))
    end = F.col("_b") + F.expr("interval 23 hours") if step == "hour" else F.col("_b")
    ends = df.groupBy(*keys).agg(first.alias("_a"), last.alias("_b"))
    return ends.select(*keys, F.explode(F.sequence(F.col("_a"), end, F.expr(STEPS[step]))).alias(ts))


def with_times(df: DataFrame, times: DataFrame, keys=KEY, ts: str = "ts") -> DataFrame:
    """df with a row for each meter's time in `times` that it lacks, other columns null there."""
    lacking = times.select(*keys, ts).distinct().join(df, [*keys, ts], "left_anti")
    return df.unionByName(lacking, allowMissingColumns=True)


def on_spine(df: DataFrame, step: str = "hour", keys=KEY, ts: str = "ts") -> DataFrame:
    """df with a row for every step, values null where there was none. df has one row at most for each."""
    return spine(df, step, keys, ts).join(df, [*keys, ts], "left")


def sum_by(df: DataFrame, step: str, value: str = "value", keys=KEY, ts: str = "ts") -> DataFrame:
    """Sums by hour, day or month; null where all values are."""
    return df.groupBy(*keys, bucket(ts, step).alias(ts)).agg(F.sum(value).alias(value))


def spread(df: DataFrame, step: str = "day", value: str = "value", keys=KEY, ts: str = "ts", coverage: bool = False, during: tuple[str, str] | None = None) -> DataFrame:
    """Readings of [ts, next ts) spread evenly over time and summed by day or hour.

    The last reading of a meter only ends the one before. A bucket is null when no time in it has a
    value. With coverage, also the share of the bucket that has one. during (first and last date)
    gives the buckets of these days only, without making those of others."""
    whole, shared = _spread(df, step, value, keys, ts, during)
    whole = whole.select(*keys, F.explode(F.sequence("first", "last", F.expr(STEPS[step]))).alias(ts), value, "coverage")
    out = whole.unionByName(shared)
    return out if coverage else out.drop("coverage")


def spread_runs(df: DataFrame, value: str = "value", keys=KEY, ts: str = "ts", during: tuple[str, str] | None = None) -> DataFrame:
    """spread() by day as runs of days of one value, with first and last date: a row or two for a reading, not one for a day."""
    whole, shared = _spread(dealt(df, *keys), "day", value, keys, ts, during)
    runs = whole.drop("coverage").unionByName(shared.select(*keys, F.col(ts).alias("first"), F.col(ts).alias("last"), value))
    return runs.select(*keys, F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"), value)


def _spread(df: DataFrame, step: str, value: str, keys, ts: str, during: tuple[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """(first to last bucket that one reading fills, buckets at readings' ends)."""
    w = in_order(keys, ts)
    parts = df.select(*keys, wall(ts).alias("_a"), wall(F.lead(ts).over(w)).alias("_b"), F.col(value).alias("_v")).where("_b is not null")
    size, one = {"hour": 3600.0, "day": 86400.0}[step], F.expr(STEPS[step])
    low, high = bucket(F.col("_a"), step), bucket(F.col("_b"), step)
    # Buckets that one reading fills are its own and need no sum; only those at its ends are shared.
    parts = parts.withColumns({"_fa": F.when(low == F.col("_a"), low).otherwise(low + one), "_fb": high})
    rate = F.try_divide(F.col("_v"), seconds("_b") - seconds("_a"))
    first, after = F.col("_fa"), F.col("_fb")
    if during:
        start, end = (F.lit(x).cast("date").cast("timestamp_ntz") for x in during)
        end = end + F.expr(STEPS["day"])
        parts = parts.where((F.col("_b") > start) & (F.col("_a") < end))
        first, after = F.greatest(first, start), F.least(after, end)
    whole = parts.where(first < after).select(*keys, first.alias("first"), (after - one).alias("last"), (rate * size).alias(value), F.when(F.col("_v").isNotNull(), 1.0).otherwise(0.0).alias("coverage"))
    head = F.struct(low.alias("t"), (seconds(F.least("_fa", "_b")) - seconds("_a")).alias("held"))
    tail = F.struct(high.alias("t"), (seconds("_b") - seconds("_fb")).alias("held"))
    edges = F.array_compact(F.array(F.when(F.col("_a") < F.col("_fa"), head), F.when((F.col("_fb") < F.col("_b")) & (F.col("_fb") >= F.col("_fa")), tail)))
    shared = parts.withColumn("_e", F.explode(edges)).select(*keys, F.col("_e.t").alias(ts), (rate * F.col("_e.held")).alias("_x"), F.when(F.col("_v").isNotNull(), F.col("_e.held")).otherwise(0.0).alias("_h"))
    shared = shared.groupBy(*keys, ts).agg(F.sum("_x").alias(value), (F.sum("_h") / size).alias("coverage"))
    return whole, shared.where((F.col(ts) >= start) & (F.col(ts) < end)) if during else shared


def spread_months(df: DataFrame, value: str = "value", keys=KEY, ts: str = "ts") -> DataFrame:
    """Readings of [ts, next ts) spread evenly over time and summed by calendar month, with the days held.

    The same sums as spread() by day and then by month, from the overlap of each reading with each month,
    so a reading gives a row a month and not a row a day."""
    w = in_order(keys, ts)
    parts = df.select(*keys, wall(ts).alias("_a"), wall(F.lead(ts).over(w)).alias("_b"), F.col(value).alias("_v")).where("_b is not null")
    last = bucket(F.col("_b") - F.expr("interval 1 microsecond"), "month")
    parts = parts.withColumn(ts, F.explode(F.sequence(bucket(F.col("_a"), "month"), last, F.expr(STEPS["month"]))))
    following = (F.col(ts) + F.expr(STEPS["month"])).cast("timestamp_ntz")
    held = seconds(F.least("_b", following)) - seconds(F.greatest("_a", ts))
    share = F.try_divide(held, seconds("_b") - seconds("_a"))
    return parts.withColumn("_held", held).groupBy(*keys, ts).agg(F.sum(F.col("_v") * share).alias(value), (F.sum("_held") / 86400.0).alias("days"))


def mean_instantaneous(df: DataFrame, step: str = "day", value: str = "value", keys=KEY, ts: str = "ts") -> DataFrame:
    """Time-weighted means by bucket of values that hold until the next reading."""
    w = in_order(keys, ts)
    parts = df.select(*keys, wall(ts).alias("_a"), wall(F.lead(ts).over(w)).alias("_b"), F.col(value).alias("_v")).where("_b is not null and _v is not null")
    size = {"hour": 3600.0, "day": 86400.0}[step]
    last = F.date_trunc(step, F.col("_b") - F.expr("interval 1 microsecond")).cast("timestamp_ntz")
    parts = parts.withColumn(ts, F.explode(F.sequence(bucket(F.col("_a"), step), last, F.expr(STEPS[step]))))
    held = F.least(seconds("_b"), seconds(ts) + size) - F.greatest(seconds("_a"), seconds(ts))
    return parts.withColumn("_held", held).groupBy(*keys, ts).agg((F.sum(F.col("_v") * F.col("_held")) / F.sum("_held")).alias(value))


def fill_forward(c: str, w: Window) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(c: str, keys=KEY, ts: str = "ts") -> Column:
    """The next value that isn't null: the last one so far, reading backwards. (A frame that ends with the
    partition would be read anew for every row.)"""
    return fill_forward(c, Window.partitionBy(*keys).orderBy(F.col(ts).desc()))


def fill_ends(df: DataFrame, value: str, keys=KEY, ts: str = "ts") -> DataFrame:
    """The value before, else the value after."""
    return df.withColumn(value, F.coalesce(fill_forward(value, in_order(keys, ts)), fill_backward(value, keys, ts)))


def interpolate(df: DataFrame, value: str, keys=KEY, ts: str = "ts") -> DataFrame:
    """Nulls between two values are linear in elapsed time, nulls after the last repeat it; `interpolated` marks filled rows."""
    w = in_order(keys, ts)
    # A value and its time travel together, so that one window each way is enough.
    df = df.withColumns({"_at": F.when(F.col(value).isNotNull(), F.struct(seconds(ts).alias("t"), F.col(value).alias("v"))), "_now": seconds(ts)})
    df = df.withColumn("_next", fill_backward("_at", keys, ts)).withColumn("_last", fill_forward("_at", w))
    before, after, t0, t1 = F.col("_last.v"), F.col("_next.v"), F.col("_last.t"), F.col("_next.t")
    between = before + (after - before) * F.try_divide(F.col("_now") - t0, t1 - t0)
    new = F.coalesce(F.col(value), between, before)
    return df.withColumn("_new", new).withColumn("interpolated", F.col(value).isNull() & F.col("_new").isNotNull()).withColumn(value, F.col("_new")).drop("_at", "_now", "_next", "_last", "_new")


def short_and_long_days(df: DataFrame, keys=KEY, ts: str = "ts") -> DataFrame:
    """(day, rows) of days with 23 or 25 hourly rows, where the clock shifts."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("rows")).where(F.col("rows").isin(23, 25))


def day_vectors(df: DataFrame, value: str, keys=KEY, ts: str = "ts") -> DataFrame:
    """24 values for each day: an hour that a shift skips is the mean of its neighbours, one that it repeats the mean of both."""
    hours = df.groupBy(*keys, F.to_date(ts).alias("day"), F.hour(ts).alias("_h")).agg(F.avg(value).alias("_v"))
    got = hours.groupBy(*keys, "day").agg(F.map_from_entries(F.collect_list(F.struct("_h", "_v"))).alias("_m"))
    all_hours = F.sequence(F.lit(0), F.lit(23))
    near = F.transform(all_hours, lambda h: F.coalesce(F.try_element_at("_m", h), (F.try_element_at("_m", h - 1) + F.try_element_at("_m", h + 1)) / 2, F.try_element_at("_m", h - 1), F.try_element_at("_m", h + 1)))
    return got.select(*keys, "day", near.alias("values"))


def months_of(df: DataFrame, months: int, keys=KEY, ts: str = "ts") -> Column:
    """Start of the calendar bucket of so many months, counted from each meter's first month."""
    first = F.min(bucket(ts, "month")).over(Window.partitionBy(*keys))
    number = (F.year(ts) - F.year(first)) * 12 + F.month(ts) - F.month(first)
    return F.add_months(first.cast("date"), F.floor(number / months).cast("int") * months)


def roll_up(df: DataFrame, months: int, means: list[str], sums: list[str], firsts: list[str], errors: list[str], keys=KEY, ts: str = "ts") -> DataFrame:
    """Predictions by month or two months: means, sums, first values in time, and errors in quadrature."""
    parts = [F.avg(c).alias(c) for c in means] + [F.sum(c).alias(c) for c in sums] + [F.min_by(c, ts).alias(c) for c in firsts] + [F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in errors]
    return df.withColumn("month", months_of(df, months, keys, ts)).groupBy(*keys, "month").agg(*parts)


def panel_by(df: DataFrame, step: str, keys=KEY, ts: str = "ts") -> DataFrame:
    """Daily mean temperature and summed use; by month, use stands on month starts and is null on other days."""
    daily = df.groupBy(*keys, bucket(ts, "day").alias(ts)).agg(F.avg("temperature").alias("temperature"), F.sum("observed").alias("observed"))
    if step == "day":
        return daily
    monthly = df.groupBy(*keys, bucket(ts, "month").alias(ts)).agg(F.sum("observed").alias("observed"))
    return daily.drop("observed").join(monthly, [*keys, ts], "left")
