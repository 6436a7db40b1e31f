"""Cleaning of readings: duplicates, nulls, granularity, off-cycle and estimated reads, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions.calendar import seconds

KEY = ("meter_id",)


def in_order(keys=KEY, ts: str = "ts") -> Window:
    return Window.partitionBy(*keys).orderBy(ts)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over enough tasks for a fit by key.

    Fits cost far more than their rows weigh, so joining partitions that are small in bytes would put all
    fits into a few tasks; a count of partitions that is given outright is kept."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def null_partial_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of the columns have all of them null."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.withColumns({c: F.when(whole, F.col(c)) for c in columns})


def first_reads(df: DataFrame, order: str, keys=KEY, ts: str = "ts") -> DataFrame:
    """The first row of each timestamp in the order of arrival."""
    w = Window.partitionBy(*keys, ts).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def zero_as_null(value: str, electricity: Column) -> Column:
    return F.when(~(electricity & (F.col(value) == 0)), F.col(value))


def on_the_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.where(F.minute(ts) == 0)


def common_range(a: DataFrame, b: DataFrame, keys=KEY, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the time that both cover, by meter; meters without such a time drop out."""
    ends = [df.groupBy(*keys).agg(F.min(ts).alias(f"_lo{i}"), F.max(ts).alias(f"_hi{i}")) for i, df in enumerate((a, b))]
    span = ends[0].join(ends[1], list(keys)).select(*keys, F.greatest("_lo0", "_lo1").alias("_lo"), F.least("_hi0", "_hi1").alias("_hi")).where("_lo <= _hi")
    return tuple(df.join(span, list(keys)).where(F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi") for df in (a, b))


def gap_days(df: DataFrame, keys=KEY, ts: str = "ts", out: str = "gap_days") -> DataFrame:
    """Days to the next read, null on the last."""
    return df.withColumn(out, (seconds(F.lead(ts).over(in_order(keys, ts))) - seconds(ts)) / 86400.0)


def granularity(df: DataFrame, keys=KEY, ts: str = "ts", default: str | None = None) -> DataFrame:
    """hourly, daily, billing_monthly or billing_bimonthly of each meter by its median gap."""
    g = gap_days(df, keys, ts).groupBy(*keys).agg(F.percentile("gap_days", 0.5).alias("median_gap"))
    m = F.col("median_gap")
    kind = F.when(m < 1, "hourly").when(m == 1, "daily").when((m > 1) & (m <= 35), "billing_monthly").when((m > 35) & (m <= 70), "billing_bimonthly")
    return g.withColumn("granularity", kind.otherwise(F.lit(default)))


def off_cycle(df: DataFrame, interval: str, value: str = "value", keys=KEY, ts: str = "ts") -> DataFrame:
    """Values of bills that don't last 25 to 35 days (monthly) or 25 to 70 (bimonthly) are null; `off_cycle` marks them."""
    most = {"billing_monthly": 35, "billing_bimonthly": 70}[interval]
    days = F.floor((seconds(F.lead(ts).over(in_order(keys, ts))) - seconds(ts)) / 86400.0)
    df = df.withColumn("_days", days)
    return df.withColumn("off_cycle", F.col("_days").isNotNull() & ~F.col("_days").between(25, most)).withColumn(value, F.when(F.col("_days").isNull() | F.col("_days").between(25, most), F.col(value))).drop("_days")


def roll_up_estimated(df: DataFrame, value: str = "value", estimated: str = "estimated", keys=KEY, ts: str = "ts") -> DataFrame:
    """An estimated read is added to the read after it and dropped. It goes one read on only: a run of
    estimated reads isn't added up."""
    w = in_order(keys, ts)
    before, after = F.lag(estimated).over(w), F.lead(ts).over(w)
    carried = F.when(F.coalesce(before, F.lit(False)), F.coalesce(F.lag(value).over(w), F.lit(0.0))).otherwise(F.lit(0.0))
    out = df.withColumn("_carried", carried).withColumn("_drop", F.coalesce(F.col(estimated), F.lit(False)) & after.isNotNull())
    return out.where("not _drop").withColumn(value, F.col(value) + F.col("_carried")).drop("_carried", "_drop")


def daily_with_coverage(df: DataFrame, per_day: int, value: str = "value", keys=KEY, ts: str = "ts", least: float = 0.5) -> DataFrame:
    """Daily sums scaled up by the share of the day's readings present, null at or under `least`."""
    day = F.to_date(ts).alias("day")
    sums = df.groupBy(*keys, day).agg(F.sum(value).alias("_sum"), (F.count(value) / F.lit(float(per_day))).alias("coverage"))
    return sums.select(*keys, "day", "coverage", F.when(F.col("coverage") > least, F.col("_sum") / F.col("coverage")).alias(value))


def training_days(df: DataFrame, bad: Column, keys=KEY, ts: str = "ts", least: int = 12) -> DataFrame:
    """Rows of the days on which 24 less the bad hours is at least `least`."""
    day = F.to_date(ts)
    good = df.groupBy(*keys, day.alias("_day")).agg(F.sum(bad.cast("int")).alias("_bad")).where(24 - F.col("_bad") >= least).drop("_bad")
    return df.withColumn("_day", day).join(good, [*keys, "_day"], "left_semi").drop("_day")


def split_valid(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with finite values in all columns, the rest)."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in columns])
    return df.where(ok), df.where(~F.coalesce(ok, F.lit(False)))


def extreme_fence(df: DataFrame, value: str = "value", keys=KEY) -> DataFrame:
    """By meter the value median + 3 IQR and how many values lie above it."""
    fence = df.groupBy(*keys).agg((F.percentile(value, 0.5) + 3 * (F.percentile(value, 0.75) - F.percentile(value, 0.25))).alias("fence"))
    return df.join(fence, list(keys)).groupBy(*keys).agg(F.first("fence").alias("fence"), F.sum((F.col(value) > F.col("fence")).cast("long")).alias("n_extreme"))


def iqr_fence(df: DataFrame, value: str, keys=KEY, sigma: float = 3.0, quantile: float = 0.25) -> DataFrame:
    """By meter (low, high): quartiles widened so that a normal's fence is at sigma deviations."""
    q1, q3 = F.percentile(value, quantile), F.percentile(value, 1 - quantile)
    wide = (q3 - q1) * (0.7413 * sigma - 0.5)
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg((q1 - wide).alias("low"), (q3 + wide).alias("high"))
