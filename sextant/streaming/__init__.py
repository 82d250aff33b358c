"""The rollup over streams: an extension, with windows, watermarks and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.rollup import aggregation, choose_aggregation


def stream_rollup(events: DataFrame, *, window: str, late: str, variable_type: str, how: str | None = None, keys=("series_id",), time: str = "ts", value: str = "value") -> DataFrame:
    """Values by key and window of event time; rows later than ``late`` are left out, and a window's state goes once it is past.

    The same aggregations and refusals as the batch rollup; the plan runs on batch frames as well.
    """
    how = choose_aggregation(variable_type, how)
    got = events.withWatermark(time, late).groupBy(*keys, F.window(time, window)).agg(aggregation(how, value, time).alias(value), F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), value, "n")


def latest_vintages(events: DataFrame, *, late: str, keys=("series_id", "obs_date"), vintage: str = "vintage_ts", value: str = "value") -> DataFrame:
    """First and last value of each observation seen so far, as vintages arrive (update mode)."""
    first, last = F.min_by(value, vintage), F.max_by(value, vintage)
    return events.withWatermark(vintage, late).groupBy(*keys).agg(first.alias("first_value"), last.alias("last_value"), F.count(F.lit(1)).alias("vintages"))
