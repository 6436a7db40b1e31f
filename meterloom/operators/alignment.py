"""Alignment of a meter's readings with its temperatures, and bills as groups of equal days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions.calendar import seconds
from meterloom.operators.cleaning import KEY, in_order


def trim_ends(df: DataFrame, value: str, keys=KEY, ts: str = "ts", keep_last: int = 0) -> DataFrame:
    """df from each meter's first to its last row with a value, and keep_last rows more (a bill's end)."""
    w = in_order(keys, ts)
    df = df.withColumn("_n", F.row_number().over(w))
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    return df.join(ends, list(keys)).where(F.col("_n").between(F.col("_a"), F.col("_b") + keep_last)).drop("_n", "_a", "_b")


def _edge_steps(df: DataFrame, name: str, keys, ts: str) -> DataFrame:
    """First and last time of each meter and the seconds of its first and last step."""
    w = in_order(keys, ts)
    gaps = df.select(*keys, ts, (seconds(F.lead(ts).over(w)) - seconds(ts)).alias("_g"))
    return gaps.groupBy(*keys).agg(F.min(ts).alias(f"{name}_first"), F.max(ts).alias(f"{name}_last"), F.coalesce(F.min_by("_g", ts), F.lit(0.0)).alias(f"{name}_head"), F.coalesce(F.max_by("_g", F.when(F.col("_g").isNotNull(), seconds(ts))), F.lit(0.0)).alias(f"{name}_tail"))


def align_series(meter: DataFrame, temperature: DataFrame, billing: bool = False, keys=KEY, ts: str = "ts") -> DataFrame:
    """value and temperature side by side over the time that both cover.

    Where a meter's step at an end is longer than the temperature's, the meter may start that much
    earlier and the temperature run that much longer, and the other way round. Of bills the last
    value is null, as it only ends the one before."""
    m = trim_ends(meter.select(*keys, ts, "value"), "value", keys, ts, 1 if billing else 0)
    t = trim_ends(temperature.select(*keys, ts, "temperature"), "temperature", keys, ts)
    span = _edge_steps(m, "m", keys, ts).join(_edge_steps(t, "t", keys, ts), list(keys))
    early, late = F.col("m_head") - F.col("t_head"), F.col("m_tail") - F.col("t_tail")
    zero = F.lit(0.0)
    span = span.select(
        *keys,
        (seconds("t_first") - F.greatest(early, zero)).alias("_ma"), (seconds("t_last") + F.greatest(-late, zero)).alias("_mb"),
        (seconds("m_first") - F.greatest(-early, zero)).alias("_ta"), (seconds("m_last") + F.greatest(late, zero)).alias("_tb"),
    )
    m = m.join(span, list(keys)).where(seconds(ts).between(F.col("_ma"), F.col("_mb"))).select(*keys, ts, "value")
    if billing:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc())) == 1
        m = m.withColumn("value", F.when(~last, F.col("value")))
    t = t.join(span, list(keys)).where(seconds(ts).between(F.col("_ta"), F.col("_tb"))).select(*keys, ts, "temperature")
    return m.join(t, [*keys, ts], "full_outer")


def temperature_coverage(hours: DataFrame, periods: DataFrame, keys=KEY, ts: str = "ts", share: float = 0.5, billing: bool = False) -> DataFrame:
    """Mean temperature of each period (its `start`), null where at most `share` of its hours have one.

    Of bills a period also needs more than half the median number of readings."""
    from meterloom.operators.joins import as_of

    marked = as_of(hours, periods.select(*keys, F.col("start")), "start", [], None, keys, ts)
    got = marked.where("start is not null").groupBy(*keys, "start").agg(F.avg("temperature").alias("_t"), F.count("temperature").alias("temperature_not_null"), (F.count("*") - F.count("temperature")).alias("temperature_null"))
    ok = F.col("temperature_not_null") > share * (F.col("temperature_not_null") + F.col("temperature_null"))
    if billing:
        middle = got.groupBy(*keys).agg(F.percentile("temperature_not_null", 0.5).alias("_m"))
        got, ok = got.join(middle, list(keys)), ok & (F.col("temperature_not_null") > 0.5 * F.col("_m"))
    out = got.withColumn("temperature", F.when(ok, F.col("_t"))).withColumn("missing_high_frequency_temperature_data", ~ok)
    return out.select(*keys, "start", "temperature", "temperature_not_null", "temperature_null", "missing_high_frequency_temperature_data")


def bill_groups(days: DataFrame, least: int = 15, keys=KEY, ts: str = "ts") -> DataFrame:
    """Runs of equal daily use as bills: observed and temperature means, days, and weights that sum to one.

    Runs shorter than `least` rows join the run before. The first run is left out, as its start isn't known."""
    w = in_order(keys, ts)
    new = F.coalesce((~F.col("observed").eqNullSafe(F.lag("observed").over(w))).cast("int"), F.lit(1))
    runs = days.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy(*keys, "_run"))
    runs = runs.withColumn("_long", size >= least)
    runs = runs.withColumn("_group", F.last(F.when(F.col("_long"), F.col("_run")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy(*keys, "_group").agg(F.min(ts).alias(ts), F.avg("observed").alias("observed"), F.avg("temperature").alias("temperature"))
    gap = (seconds(ts) - seconds(F.lag(ts).over(w))) / 86400.0
    g = g.withColumn("days", gap).where("days is not null")
    return g.withColumn("weight", F.col("days") / F.sum("days").over(Window.partitionBy(*keys))).drop("_group")
