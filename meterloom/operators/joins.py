"""Joins in time: as-of, nearest, outer alignment, and profiles' nearest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions.calendar import seconds, wall
from meterloom.operators.cleaning import KEY
from meterloom.operators.resample import bucket


def as_of(left: DataFrame, right: DataFrame, right_ts: str, values: list[str], tolerance_days: float | None = None, keys=KEY, ts: str = "ts") -> DataFrame:
    """Each left row with the latest right row at or before it, within the tolerance; else nulls.

    One union and one sorted window: no rows are multiplied, and both sides shuffle once. Of right
    rows at the same time any one is taken."""
    names = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, wall(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*names, ts).alias("_left"), F.lit(None).cast(right.select(F.struct(right_ts, *values).alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(*keys, wall(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(right_ts, *values).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance_days is not None:
        both = both.withColumn("_right", F.when(seconds("_t") - seconds(F.col("_right")[right_ts]) <= tolerance_days * 86400.0, F.col("_right")))
    return both.select(*keys, "_left.*", *(F.col("_right")[c].alias(c if c not in left.columns else f"{c}_right") for c in (right_ts, *values)))


def nearest(df: DataFrame, targets: DataFrame, target: str, keys=KEY, ts: str = "ts") -> DataFrame:
    """The timestamp nearest each target of a meter, the later of two as near."""
    gap = F.abs(seconds(ts) - seconds(target))
    return df.join(targets, list(keys)).groupBy(*keys, target).agg(F.min_by(ts, F.struct(gap, -seconds(ts))).alias("nearest"))


def padded(df: DataFrame, targets: DataFrame, target: str, keys=KEY, ts: str = "ts") -> DataFrame:
    """The latest timestamp at or before each target of a meter."""
    return df.join(targets, list(keys)).where(F.col(ts) <= F.col(target)).groupBy(*keys, target).agg(F.max(ts).alias("padded"))


def align(frames: list[DataFrame], keys=KEY, ts: str = "ts", whole: bool = False) -> DataFrame:
    """Full outer join by meter and time; with `whole`, only rows without a null."""
    out = reduce(lambda a, b: a.join(b, [*keys, ts], "full_outer"), frames)
    return out.dropna() if whole else out


def use_with_temperature(meter: DataFrame, temperature: DataFrame, step: str = "day", keys=KEY, ts: str = "ts") -> DataFrame:
    """Summed use beside mean temperature of each step, all steps of either."""
    use = meter.groupBy(*keys, bucket(ts, step).alias(ts)).agg(F.sum("value").alias("observed"))
    heat = temperature.groupBy(*keys, bucket(ts, step).alias(ts)).agg(F.avg("temperature").alias("temperature"))
    return use.join(heat, [*keys, ts], "full_outer")


def nearest_profile(unknown: DataFrame, known: DataFrame, id_: str, profile: str, label: str, keys=KEY) -> DataFrame:
    """Label of the known profile at least Euclidean distance from each unknown one of the same meter.

    A meter has at most 84 profiles (month and weekday), so its pairs are bounded."""
    b = known.select(*keys, F.col(id_).alias("_id"), F.col(profile).alias("_p"), F.col(label).alias("_l"))
    gap = F.aggregate(F.zip_with(profile, "_p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    return unknown.join(b, list(keys)).groupBy(*keys, id_).agg(F.min_by("_l", F.struct(gap, "_id")).alias(label))
