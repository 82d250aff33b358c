"""The cadence ladder and the ends of its periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.columns import ColumnLike, col


class CadenceError(ValueError):
    """A cadence, variable type or aggregation that the ladder does not allow."""


# The ladder from fine to coarse, what a variable type is aggregated by, what is refused for it, periods in a year.
CADENCES = ("daily", "weekly", "monthly", "quarterly", "annual", "irregular")
AGGREGATION = {"flow": "sum", "stock": "last", "rate": "mean", "price": "last", "count": "sum", "sentiment": "mean", "event": "sum"}
REFUSED = {("stock", "sum"), ("rate", "sum"), ("price", "sum"), ("flow", "mean")}
AGGREGATIONS = ("sum", "mean", "last", "first", "max", "min", "median")
YEAR = {"daily": 365, "weekly": 52, "monthly": 12, "quarterly": 4, "annual": 1}


def rank_of(cadence: str) -> int:
    if cadence not in CADENCES:
        raise CadenceError(f"unknown cadence {cadence!r}")
    return CADENCES.index(cadence)


def period_start(date: ColumnLike, cadence: str) -> Column:
    unit = {"weekly": "WEEK", "monthly": "MONTH", "quarterly": "QUARTER", "annual": "YEAR"}.get(cadence)
    return F.trunc(col(date), unit) if unit else col(date).cast("date")


def period_end(date: ColumnLike, cadence: str) -> Column:
    """Sunday, or the last day of the month, quarter or year; any other cadence leaves the date."""
    start = period_start(date, cadence)
    if cadence == "weekly":
        return F.date_add(start, 6)
    months = {"monthly": 0, "quarterly": 2, "annual": 11}.get(cadence)
    return start if months is None else F.last_day(F.add_months(start, months))


def step(cadence: str) -> Column:
    """The interval from one period's start to the next's."""
    return F.expr({"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month", "quarterly": "interval 3 months", "annual": "interval 12 months"}[cadence])
