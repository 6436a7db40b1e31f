"""Meter and temperature tables from CSV, JSON and Parquet, and back to CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions.calendar import local_time
from meterloom.functions.scalar import fahrenheit
from meterloom.operators.resample import bucket

TIMES = ("start", "Start", "Datetime", "datetime", "timestamp", "Timestamp", "dt", "ts")


def time_column(df: DataFrame) -> str:
    """The first column of df with a name for times."""
    for c in TIMES:
        if c in df.columns:
            return c
    raise ValueError(f"none of {TIMES} among {df.columns}")


def _utc(c: str) -> Column:
    """Wall-clock UTC of a text with or without an offset; null if it is no time."""
    return F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")


def _resampled(df: DataFrame, value: str, frequency: str | None) -> DataFrame:
    if frequency is None:
        return df
    step = {"hourly": "hour", "daily": "day"}.get(frequency)
    if step is None:
        raise ValueError(f"unknown frequency {frequency}")
    keys = [c for c in df.columns if c not in ("ts", value)]
    return df.groupBy(*keys, bucket("ts", step).alias("ts")).agg(F.sum(value).alias(value))


def meter_csv(spark: SparkSession, path: str, tz: str | None = None, start: str = "start", value: str = "value", frequency: str | None = None, meter: str | None = None) -> DataFrame:
    """meter_id, ts, value of CSV files with a header (gzip too). Without a meter column the id is the file's name.

    Times are read as UTC and shown in `tz`; with a frequency, values are summed by hour or day, null
    where all are."""
    raw = spark.read.option("header", True).csv(path)
    key = F.col(meter).cast("string") if meter else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?(?:\.gz)?$", 1)
    df = raw.select(key.alias("meter_id"), _utc(start).alias("ts"), F.expr(f"try_cast(`{value}` as double)").alias("value"))
    return _resampled(df.withColumn("ts", local_time("ts", tz)) if tz else df, "value", frequency)


def temperature_csv(spark: SparkSession, path: str, tz: str | None = None, date: str = "dt", value: str = "tempF", celsius: bool = False, frequency: str | None = None, site: str | None = None) -> DataFrame:
    """meter_id (the site), ts, temperature in degrees Fahrenheit. An hourly frequency sums, as readings of an hour are expected to be one."""
    df = meter_csv(spark, path, tz, date, value, None, site).withColumnRenamed("value", "temperature")
    if celsius:
        df = df.withColumn("temperature", fahrenheit(F.col("temperature")))
    return _resampled(df, "temperature", frequency)


def meter_json(df: DataFrame, column: str, key: str = "meter_id", orient: str = "list") -> DataFrame:
    """Readings from JSON text: [[start, value], ...] (list) or [{start, value, estimated}, ...] (records).

    Values that aren't numbers are null; estimated is true for true, "true", "True", 1 and "1"."""
    if orient == "list":
        items = F.explode(F.from_json(column, "array<array<string>>"))
        df = df.select(key, items.alias("_x"))
        return df.select(key, F.try_to_timestamp(F.col("_x")[0]).cast("timestamp_ntz").alias("ts"), F.expr("try_cast(_x[1] as double)").alias("value"))
    if orient == "records":
        items = F.explode(F.from_json(column, "array<struct<start:string,value:string,estimated:string>>"))
        df = df.select(key, items.alias("_x"))
        estimated = F.coalesce(F.lower("_x.estimated").isin("true", "1"), F.lit(False))
        return df.select(key, F.try_to_timestamp("_x.start").cast("timestamp_ntz").alias("ts"), F.expr("try_cast(_x.value as double)").alias("value"), estimated.alias("estimated"))
    raise ValueError(f"unknown orientation {orient}")


def temperature_json(df: DataFrame, column: str, key: str = "meter_id", orient: str = "list") -> DataFrame:
    if orient != "list":
        raise ValueError(f"unknown orientation {orient}")
    return meter_json(df, column, key).withColumnRenamed("value", "temperature")


def write_csv(df: DataFrame, path: str, value: str = "value", time: str = "start") -> None:
    """A folder of CSV files with a header: meter_id, time in UTC and value."""
    df.select("meter_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(time), value).write.option("header", True).csv(path)


def panel(spark: SparkSession, paths: list[str], tz: str = "America/Chicago", shift_hours: int = 0) -> tuple[DataFrame, DataFrame]:
    """(baseline, reporting) of a panel with id, datetime, temperature, observed_baseline and observed_reporting.

    Reporting stands 365 days later."""
    raw = spark.read.parquet(*paths)
    at = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("datetime").cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, {shift_hours})"))
    rows = raw.withColumn("ts", at)
    base = rows.select(F.col("id").alias("meter_id"), "ts", "temperature", F.col("observed_baseline").alias("observed"))
    later = rows.select(F.col("id").alias("meter_id"), (F.col("ts") + F.expr("interval 365 days")).alias("ts"), "temperature", F.col("observed_reporting").alias("observed"))
    return base, later


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (gzip too), JSON, ORC or Parquet table by its name's end."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    kind = name.rsplit(".", 1)[-1]
    if kind not in ("json", "parquet", "orc"):
        raise ValueError(f"unknown kind of file {path}")
    return spark.read.format(kind).load(path)
