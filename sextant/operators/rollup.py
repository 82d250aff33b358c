"""Rollup along the cadence ladder, with an audit, and alignment of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.periods import AGGREGATION, AGGREGATIONS, REFUSED, CadenceError, period_end, period_start, rank_of, step


def aggregation(how: str, value: str = "value", date: str = "obs_date") -> Column:
    """A period's value; last and first skip nulls, the sum of nothing but nulls is zero."""
    return {
        "sum": F.coalesce(F.sum(value), F.lit(0.0)),
        "mean": F.avg(value),
        "last": F.max_by(value, F.when(F.col(value).isNotNull(), F.col(date))),
        "first": F.min_by(value, F.when(F.col(value).isNotNull(), F.col(date))),
        "max": F.max(value),
        "min": F.min(value),
        "median": F.median(value),
    }[how]


def choose_aggregation(variable_type: str, how: str | None = None, overridden: bool = False) -> str:
    """The type's own aggregation, or the one asked for unless it is refused for the type."""
    if variable_type not in AGGREGATION:
        raise CadenceError(f"unknown variable type {variable_type!r}")
    how = how or AGGREGATION[variable_type]
    if how not in AGGREGATIONS:
        raise CadenceError(f"unknown aggregation {how!r}")
    if (variable_type, how) in REFUSED and not overridden:
        raise CadenceError(f"{how} of a {variable_type} is unsafe; override to use it")
    return how


def rollup(df: DataFrame, *, source: str, target: str, variable_type: str, how: str | None = None, overridden: bool = False, drop_partial: bool = True, fill_gaps: bool = True, keys=("series_id",), date: str = "obs_date", value: str = "value") -> DataFrame:
    """One row for each key and period end: keys, date, value, n (rows in the period).

    The same cadence gives the rows as they are. Going down the ladder is refused, and so is an aggregation that is unsafe for the
    variable type. A period is dropped at a series' end if its last date is before the period's end. Periods without rows are
    filled in between (a sum is 0, anything else null); the spine is made per series, from its first and last period.
    """
    if rank_of(source) > rank_of(target):
        raise CadenceError(f"cannot go from {source} to {target}")
    how = choose_aggregation(variable_type, how, overridden)
    keys = list(keys)
    rows = df.select(*keys, F.col(date).cast("date").alias(date), F.col(value).cast("double").alias(value))
    if source == target:
        return rows.withColumn("n", F.lit(1).cast("long"))
    if target == "irregular":
        raise CadenceError("there are no irregular periods to go to")
    got = rows.withColumn("_start", period_start(date, target)).groupBy(*keys, "_start").agg(aggregation(how, value, date).alias(value), F.count(F.lit(1)).alias("n"), F.max(date).alias("_last"))
    if drop_partial:
        end = got.groupBy(*keys).agg(F.max("_last").alias("_end"))
        got = got.join(end, keys).where(period_end("_start", target) <= period_end(F.col("_end"), target)).where((period_end("_start", target) <= F.col("_end")) | (F.col("_last") < F.col("_end"))).drop("_end")
    if fill_gaps:
        spine = got.groupBy(*keys).agg(F.min("_start").alias("_a"), F.max("_start").alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b", step(target))).alias("_start"))
        got = spine.join(got, [*keys, "_start"], "left")
        got = got.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        if how == "sum":
            got = got.withColumn(value, F.coalesce(value, F.lit(0.0)))
    return got.select(*keys, period_end("_start", target).alias(date), value, "n")


def rollup_audit(df: DataFrame, rolled: DataFrame, *, source: str, target: str, variable_type: str, how: str | None = None, overridden: bool = False, keys=("series_id",), date: str = "obs_date") -> DataFrame:
    """A row for each series: how it was rolled up, periods made, whether a partial one was dropped, periods without values."""
    keys = list(keys)
    how = choose_aggregation(variable_type, how, overridden)
    last = df.groupBy(*keys).agg(F.max(F.col(date).cast("date")).alias("_last"))
    made = rolled.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods_created"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing_periods"), F.max(date).alias("_end"))
    return last.join(made, keys, "left").select(
        *keys, F.lit(source).alias("source_cadence"), F.lit(target).alias("target_cadence"), F.lit(variable_type).alias("variable_type"), F.lit(how).alias("aggregation"), F.lit(overridden).alias("aggregation_overridden"),
        F.coalesce("periods_created", F.lit(0).cast("long")).alias("periods_created"), (F.lit(source != target) & (period_end("_last", target) > F.col("_last"))).alias("partial_dropped"), F.coalesce("missing_periods", F.lit(0).cast("long")).alias("missing_periods"), F.lit(0).cast("long").alias("duplicate_timestamps_resolved"),
    )


def apply_release_lag(df: DataFrame, days: int, date: str = "obs_date") -> DataFrame:
    """Dates as of publication, ``days`` later."""
    if days < 0:
        raise ValueError("a release lag cannot be negative")
    return df.withColumn(date, F.date_add(F.col(date).cast("date"), days))


def snap(df: DataFrame, cadence: str, date: str = "obs_date") -> DataFrame:
    """Dates at their period's end; cadences without periods leave them."""
    return df.withColumn(date, period_end(date, cadence))


def between(df: DataFrame, period: str, date: str = "obs_date") -> DataFrame:
    """Rows of ``start/end``, both included."""
    start, slash, end = period.partition("/")
    if not slash:
        raise ValueError(f"a period is start/end, not {period!r}")
    return df.where(F.col(date).between(F.lit(start.strip()).cast("date"), F.lit(end.strip()).cast("date")))
