"""Baseline and reporting periods, their gaps, and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions.calendar import seconds, wall
from meterloom.operators.cleaning import KEY, in_order


def _days(n: int) -> Column:
    return F.expr(f"make_dt_interval({n})")


def _after_last_null(df: DataFrame, value: str | None, keys, ts: str) -> DataFrame:
    if value is None:
        return df
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc())) == 1
    return df.withColumn(value, F.when(~last, F.col(value)))


def baseline(df: DataFrame, end: str | None = None, max_days: int = 365, value: str | None = "value", overshoot: bool = False, keys=KEY, ts: str = "ts") -> DataFrame:
    """Rows up to `end` (a column, or the meter's last time) from max_days before it.

    With overshoot the start is the reading nearest that time, so that a billing period isn't cut.
    The last row's value is null, as it only ends the period before."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_end", F.col(end) if end else F.max(ts).over(w)).where(wall(ts) <= wall("_end"))
    df = df.withColumn("_start", wall("_end") - _days(max_days))
    if overshoot:
        gap = F.abs(seconds(ts) - seconds("_start"))
        df = df.withColumn("_start", F.min_by(F.col(ts), F.struct(gap, -seconds(ts))).over(w))
    return _after_last_null(df.where(wall(ts) >= wall("_start")).drop("_start", "_end"), value, keys, ts)


def reporting(df: DataFrame, start: str | None = None, max_days: int = 365, value: str | None = "value", overshoot: bool = False, keys=KEY, ts: str = "ts") -> DataFrame:
    """Rows from `start` (a column, or the meter's first time) to max_days after it; mirror image of baseline."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_start", F.col(start) if start else F.min(ts).over(w)).where(wall(ts) >= wall("_start"))
    df = df.withColumn("_end", wall("_start") + _days(max_days))
    if overshoot:
        gap = F.abs(seconds(ts) - seconds("_end"))
        df = df.withColumn("_end", F.min_by(F.col(ts), F.struct(gap, -seconds(ts))).over(w))
    return _after_last_null(df.where(wall(ts) <= wall("_end")).drop("_start", "_end"), value, keys, ts)


def gap_warnings(name: str, data_start: Column, data_end: Column, start: Column, end: Column) -> Column:
    """Warnings where the data begin after the period's start or end before its end."""
    of = F.struct(F.lit(f"meterloom.get_{name}_data.gap_at_{name}_start").alias("qualified_name"), F.lit("Data doesn't reach back to the requested start.").alias("description"))
    to = F.struct(F.lit(f"meterloom.get_{name}_data.gap_at_{name}_end").alias("qualified_name"), F.lit("Data doesn't reach the requested end.").alias("description"))
    return F.array_compact(F.array(F.when(data_start > start, of), F.when(data_end < end, to)))


def terms(df: DataFrame, lengths: list[int], labels: list[str], method: str = "strict", keys=KEY, ts: str = "ts") -> DataFrame:
    """Terms of given lengths in days, one after another from each meter's first time.

    A term's end is the latest time at or before its target (strict) or the nearest one. A term is
    complete when it has more than one time."""
    targets, total = [], 0
    for label, n in zip(labels, lengths):
        total += n
        targets.append(F.struct(F.lit(len(targets)).alias("term"), F.lit(label).alias("label"), F.lit(n).alias("days"), F.lit(total).alias("offset")))
    first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
    wanted = first.withColumn("_t", F.explode(F.array(*targets))).select(*keys, "_first", "_t.*")
    target = seconds("_first") + F.col("offset") * 86400.0
    rows = df.select(*keys, F.col(ts).alias("_ts")).distinct().join(wanted, list(keys)).withColumn("_target", target)
    if method == "strict":
        cut = F.max(F.when(seconds("_ts") <= F.col("_target"), F.col("_ts")))
    elif method == "nearest":
        cut = F.min_by("_ts", F.struct(F.abs(seconds("_ts") - F.col("_target")), -seconds("_ts")))
    else:
        raise ValueError(f"unknown method {method}")
    ends = rows.groupBy(*keys, "term", "label", "days").agg(cut.alias("end"), F.first("_first").alias("_first"))
    start = F.coalesce(F.lag("end").over(in_order(keys, "term")), F.col("_first"))
    out = ends.withColumn("start", start)
    inside = out.join(df.select(*keys, F.col(ts).alias("_ts")).distinct(), list(keys)).where("_ts between start and end").groupBy(*keys, "term").agg(F.count("*").alias("rows"))
    return out.join(inside, [*keys, "term"]).select(*keys, "term", "label", "start", "end", F.col("days").alias("target_days"), ((seconds("end") - seconds("start")) / 86400.0).alias("actual_days"), (F.col("rows") > 1).alias("complete"))
