"""Calendar parts, seasons, day types and time zones as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Season of each month, January first.
SEASONS = ["winter", "winter", "shoulder", "shoulder", "shoulder", "summer", "summer", "summer", "summer", "shoulder", "winter", "winter"]


def wall(ts: str | Column) -> Column:
    """ts without a zone."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of the wall-clock time, with fractions."""
    t = wall(ts)
    days = F.unix_date(t.cast("date")).cast("double")
    return days * 86400.0 + F.hour(t) * 3600.0 + F.minute(t) * 60.0 + F.extract(F.lit("SECOND"), t).cast("double")


def local_time(ts: str, tz: str | Column) -> Column:
    """Wall-clock time in zone tz (a name or a column) of an instant stored as UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz) if isinstance(tz, str) else tz, wall(ts))


def utc_time(ts: str, tz: str | Column) -> Column:
    """The UTC wall-clock time of a local time; times that a shift skips move forward, repeated ones are the first."""
    return F.convert_timezone(F.lit(tz) if isinstance(tz, str) else tz, F.lit("UTC"), wall(ts))


def season(ts: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), F.month(ts))


def weekday(ts: str | Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts)


def day_type(ts: str | Column, weekend: tuple[int, ...] = (5, 6)) -> Column:
    return F.when(F.weekday(ts).isin(*weekend), "weekend").otherwise("weekday")


def hour_of_week(ts: str | Column) -> Column:
    """24 * weekday + hour, 0 to 167."""
    return F.weekday(ts) * 24 + F.hour(ts)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days of 24 hours."""
    return (seconds(later) - seconds(earlier)) / 86400.0


def floor_hour(ts: str) -> Column:
    return F.date_trunc("HOUR", wall(ts)).cast("timestamp_ntz")


def ceil_hour(ts: str) -> Column:
    floor = floor_hour(ts)
    return F.when(floor == wall(ts), floor).otherwise(floor + F.expr("interval 1 hour"))


def round_hour(ts: str) -> Column:
    """The nearest hour, halves to the even hour."""
    floor = floor_hour(ts)
    past = seconds(wall(ts)) - seconds(floor)
    up = (past > 1800) | ((past == 1800) & (F.hour(floor) % 2 == 1))
    return F.when(up, floor + F.expr("interval 1 hour")).otherwise(floor)


def add_days(ts: str, n: int) -> Column:
    """n times 24 hours later."""
    return wall(ts) + F.expr(f"make_dt_interval({n})")


def at_hour(ts: str, hour: int) -> Column:
    """The same day at a given hour."""
    return F.date_trunc("DAY", wall(ts)).cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, {hour})")
