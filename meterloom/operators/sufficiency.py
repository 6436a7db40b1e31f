"""Whether a meter's data suffice for a baseline or a report: rules on one aggregate by meter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.functions.calendar import seconds
from meterloom.operators.cleaning import KEY, in_order, off_cycle

PREFIX = "meterloom.sufficiency_criteria"


@dataclass(frozen=True)
class Criteria:
    """Days asked for and least shares of them."""

    num_days: int = 365
    daily_coverage: float = 0.9
    hourly_coverage: float = 0.9


#: Rules of each class of data, baseline and reporting, in the order in which they are checked.
RULES = {
    "daily": {
        "baseline": ("no_data", "negative_meter_values", "incorrect_number_of_total_days", "too_many_days_with_missing_data", "too_many_days_with_missing_meter_data", "too_many_days_with_missing_temperature_data", "missing_monthly_temperature_data"),
        "reporting": ("no_data", "too_many_days_with_missing_data", "too_many_days_with_missing_temperature_data", "missing_monthly_temperature_data"),
    }
}
RULES["billing"] = RULES["daily"]
RULES["hourly"] = {"baseline": (*RULES["daily"]["baseline"], "missing_monthly_meter_data", "missing_monthly_ghi_data"), "reporting": (*RULES["daily"]["reporting"], "missing_monthly_ghi_data")}


def statistics(df: DataFrame, keys=KEY, ts: str = "ts", criteria: Criteria = Criteria(), requested_start: str | None = None, requested_end: str | None = None) -> DataFrame:
    """One row a meter. df: observed, temperature_not_null and temperature_null (readings in each row's period), and temperature and ghi if they are there.

    A row lasts until the next; the last row counts no days. Days are valid in temperature when more than the least share of
    its readings has one, in use when it isn't null. requested_start and requested_end name columns (one value a meter); whole
    days between them and the data count as days in all. Shares by month of the year: the least of a meter's; without a
    temperature column a row has a temperature if any reading has, without ghi there is no share of it."""
    w = in_order(keys, ts)
    share = F.try_divide(F.col("temperature_not_null"), F.col("temperature_not_null") + F.col("temperature_null"))
    days = (seconds(F.lead(ts).over(w)) - seconds(ts)) / 86400.0
    warm = F.col("temperature").isNotNull() if "temperature" in df.columns else F.coalesce(F.col("temperature_not_null"), F.lit(0)) > 0
    sun = F.col("ghi").isNotNull() if "ghi" in df.columns else F.lit(None).cast("boolean")
    df = df.withColumns({"_days": F.coalesce(days, F.lit(0.0)), "_t": F.coalesce(share > criteria.hourly_coverage, F.lit(False)), "_m": F.col("observed").isNotNull(), "_w": warm, "_g": sun, "_at": seconds(ts)})
    whole = F.col("_m") & (F.coalesce(F.col("temperature_not_null"), F.lit(0)) > 0)
    by_month = {"_m": "min_month_meter", "_w": "min_month_temperature", "_g": "min_month_ghi"}
    monthly = df.groupBy(*keys, F.month(ts).alias("_month")).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in by_month)).groupBy(*keys).agg(*(F.min(c).alias(name) for c, name in by_month.items()))
    fence = df.groupBy(*keys).agg(F.percentile("observed", 0.5).alias("_q2"), F.percentile("observed", 0.25).alias("_q1"), F.percentile("observed", 0.75).alias("_q3"))
    df = df.join(fence, list(keys))
    first, last = F.min(F.when(whole, F.col("_at"))), F.max(F.when(whole, F.col("_at")))
    before = F.floor((first - seconds(F.first(requested_start))) / 86400.0) if requested_start else F.lit(0)
    after = F.floor((seconds(F.first(requested_end)) - last) / 86400.0) if requested_end else F.lit(0)
    stats = df.groupBy(*keys).agg(
        F.sum(whole.cast("long")).alias("n_complete"),
        (F.floor((last - first) / 86400.0) + 1 + before + after).cast("int").alias("n_days_total"),
        before.cast("int").alias("n_days_start_gap"),
        after.cast("int").alias("n_days_end_gap"),
        F.sum(F.when(F.col("_m"), F.col("_days")).otherwise(0.0)).cast("int").alias("n_valid_meter_days"),
        F.sum(F.when(F.col("_t"), F.col("_days")).otherwise(0.0)).cast("int").alias("n_valid_temperature_days"),
        F.sum(F.when(F.col("_t") & F.col("_m"), F.col("_days")).otherwise(0.0)).cast("int").alias("n_valid_days"),
        F.sum((F.col("observed") < 0).cast("long")).alias("n_negative"),
        F.sum((F.col("observed") > F.col("_q2") + 3 * (F.col("_q3") - F.col("_q1"))).cast("long")).alias("n_extreme"),
    )
    return stats.join(monthly, list(keys))


def _rule(name: str, broken: Column, description: str) -> Column:
    return F.when(broken, F.struct(F.lit(f"{PREFIX}.{name}").alias("qualified_name"), F.lit(description).alias("description")))


def judge(stats: DataFrame, kind: str = "baseline", electricity: bool = True, criteria: Criteria = Criteria(), model: str = "daily", window: bool = False) -> DataFrame:
    """stats with arrays `disqualification` and `warnings` of broken rules: those of RULES for the model's data, in their order.

    A span counts as wrong when it is longer than the days asked for, or shorter than nine tenths of them. A meter without a
    complete row has no share of valid days, which is too few. A report asks for no use, so its days are valid by
    temperature alone. Electricity may be negative. With window, data beyond the requested times disqualify too."""
    n = F.col("n_days_total")

    def few(c: str) -> Column:
        return F.coalesce(F.when(n > 0, F.col(c) / n) < criteria.daily_coverage, F.lit(True))

    def low(c: str) -> Column:
        return F.col(c) < criteria.daily_coverage

    broken = {
        "no_data": (F.col("n_complete") == 0, "No data available."),
        "negative_meter_values": (F.lit(not electricity) & (F.col("n_negative") > 0), "Found negative meter data values."),
        "incorrect_number_of_total_days": ((n > criteria.num_days) | (n < int(0.9 * criteria.num_days + 0.999)), "Baseline length isn't within the expected range."),
        "too_many_days_with_missing_data": (few("n_valid_days" if kind == "baseline" else "n_valid_temperature_days"), "Too many days in data have missing meter data or temperature data."),
        "too_many_days_with_missing_meter_data": (few("n_valid_meter_days"), "Too many days in data have missing meter data."),
        "too_many_days_with_missing_temperature_data": (few("n_valid_temperature_days"), "Too many days in data have missing temperature data."),
        "missing_monthly_temperature_data": (low("min_month_temperature"), "More than a tenth of a month's temperature data is missing."),
        "missing_monthly_meter_data": (low("min_month_meter"), "More than a tenth of a month's meter data is missing."),
        "missing_monthly_ghi_data": (low("min_month_ghi"), "More than a tenth of a month's irradiance data is missing."),
        "extra_data_before_requested_start_date": (F.col("n_days_start_gap") < 0, "Extra data found before requested start date."),
        "extra_data_after_requested_end_date": (F.col("n_days_end_gap") < 0, "Extra data found after requested end date."),
    }
    names = [*RULES[model][kind], *(x for x in broken if window and x.startswith("extra_"))]
    rules = [_rule(x, *broken[x]) for x in names]
    warnings = [_rule("extreme_values_detected", F.lit(kind == "baseline") & (F.col("n_extreme") > 0), "Extreme values are present.")]
    return stats.withColumn("disqualification", F.array_compact(F.array(*rules))).withColumn("warnings", F.array_compact(F.array(*warnings)))


def off_cycle_rule(bills: DataFrame, interval: str, value: str = "value", keys=KEY, ts: str = "ts") -> DataFrame:
    """By meter with a value, whether a bill lasts shorter or longer than the interval allows, as `disqualification`."""
    marked = off_cycle(bills.withColumn("_has", F.col(value).isNotNull()), interval, value, keys, ts).groupBy(*keys).agg(F.max("_has").alias("_has"), F.max("off_cycle").alias("_off"))
    rule = _rule("offcycle_reads_in_billing_monthly_data", F.col("_off"), "Bills are shorter or longer than the interval allows.")
    return marked.where("_has").select(*keys, F.array_compact(F.array(rule)).alias("disqualification"))


def coverage_warnings(df: DataFrame, column: str, keys=KEY, ts: str = "ts", least: float = 0.5) -> DataFrame:
    """By meter a warning if rows have at most `least` of their readings, with how many; column: meter or temperature, df: coverage."""
    n = df.groupBy(*keys).agg(F.sum((F.col("coverage") <= least).cast("long")).alias("n_uncovered"))
    rule = _rule(f"missing_high_frequency_{column}_data", F.col("n_uncovered") > 0, f"Rows lack more than half of their {column} readings.")
    return n.withColumn("warnings", F.array_compact(F.array(rule)))


def report(judged: DataFrame) -> DataFrame:
    """How many meters break each rule: a log of a panel, one row a rule."""
    each = judged.select(F.explode(F.concat(F.transform("disqualification", lambda x: F.struct(x["qualified_name"].alias("rule"), F.lit(True).alias("disqualifies"))), F.transform("warnings", lambda x: F.struct(x["qualified_name"].alias("rule"), F.lit(False).alias("disqualifies"))))).alias("r"))
    return each.groupBy("r.rule", "r.disqualifies").agg(F.count("*").alias("meters"))


def status(stats: DataFrame, requested_days: int = 365, share: float = 0.9) -> DataFrame:
    """NO DATA, FAIL or PASS by the older rules: exactly the days asked for, and enough of them valid."""
    n = F.col("n_days_total")
    ok = (n - 1 == requested_days) & (F.col("n_valid_days") / requested_days >= share) & (F.col("n_valid_meter_days") / requested_days >= share) & (F.col("n_valid_temperature_days") / requested_days >= share)
    return stats.withColumn("status", F.when(F.col("n_complete") == 0, "NO DATA").when(ok, "PASS").otherwise("FAIL"))


def longest_null_run(df: DataFrame, value: str, keys=KEY, ts: str = "ts") -> DataFrame:
    """By meter the most rows in a row without a value: gaps and islands."""
    w = in_order(keys, ts)
    gone = F.col(value).isNull()
    df = df.withColumn("_gone", gone).withColumn("_new", F.coalesce((gone != F.lag(gone).over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*keys, "_run").agg(F.sum(F.col("_gone").cast("long")).alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("longest_null_run"))


def hide_interpolated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Interpolated values are null again, as checks want them."""
    return df.withColumns({c: F.when(~F.coalesce(F.col(f"interpolated_{c}"), F.lit(False)), F.col(c)) for c in columns})
