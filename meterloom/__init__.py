"""Panel analytics of metered energy use on Spark: cleaning, resampling, baselines, prediction and savings for many meters at once.

Tables have a `meter_id` and a `ts`; ts is wall-clock time of the meter (timestamp_ntz), or an
instant that `calendar.local_time` turns into it.
"""
