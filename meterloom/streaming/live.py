"""Streaming forms: hourly use with late readings, and a running estimate of what a meter saves.

The batch operators have no counterpart to these; they let a stream of readings feed the same
tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_use(readings: DataFrame, lateness: str = "2 hours", key: str = "meter_id") -> DataFrame:
    """Sums by meter and hour of a stream with an instant `ts`; readings later than `lateness` are left out."""
    by = readings.withWatermark("ts", lateness).groupBy(key, F.window("ts", "1 hour"))
    return by.agg(F.sum("value").alias("value"), F.count("value").alias("n")).select(key, F.col("window.start").alias("ts"), "value", "n")


def quiet_spells(readings: DataFrame, gap: str = "6 hours", lateness: str = "2 hours", key: str = "meter_id") -> DataFrame:
    """Sessions of readings that end after a gap."""
    by = readings.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", gap))
    return by.agg(F.sum("value").alias("value"), F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "value", "n")


def roll_up_estimated(readings: DataFrame, key: str = "meter_id") -> DataFrame:
    """Readings with an estimated one added to the next; the estimate waits in state until that comes."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, value, estimated in zip(rows["ts"], rows["value"], rows["estimated"]):
            if estimated:
                waiting = value
            else:
                out.append((group[0], ts, value + (waiting or 0.0)))
                waiting = None
        state.update((waiting,))
        yield pd.DataFrame(out, columns=[key, "ts", "value"])

    kind = readings.schema[key].dataType.simpleString()
    return readings.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, value double", "waiting double", "append", GroupStateTimeout.NoTimeout)
