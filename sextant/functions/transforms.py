"""Named transforms of a series, as window expressions over (series, date)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.columns import ratio
from sextant.functions.periods import YEAR

KEYS, DATE, VALUE = ("series_id",), "obs_date", "value"


def _over(keys, date):
    return Window.partitionBy(*keys).orderBy(date)


def lag(k: int, keys=KEYS, date: str = DATE, value: str = VALUE):
    """The value k rows before; ahead, for a negative k."""
    return F.lag(value, k).over(_over(keys, date)) if k >= 0 else F.lead(value, -k).over(_over(keys, date))


def _raw(df: DataFrame, out: str, keys, date, value, cadence) -> DataFrame:
    return df.withColumn(out, F.col(value))


def _diff(df, out, keys, date, value, cadence, periods: int = 1):
    return df.withColumn(out, F.col(value) - lag(periods, keys, date, value))


def _change(df, out, keys, date, value, cadence, periods=1):
    """Relative change over some periods; gaps count as the last value before them."""
    k = periods(cadence) if callable(periods) else periods
    filled = df.withColumn("_filled", F.last(value, ignorenulls=True).over(_over(keys, date).rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn(out, ratio("_filled", lag(k, keys, date, "_filled")) - 1).drop("_filled")


def _rolling(df, out, keys, date, value, cadence, window: int = 3, of: str = "mean"):
    """Over the last rows; null until there are enough, and while one of them is null."""
    w = _over(keys, date).rowsBetween(-(window - 1), 0)
    mean = F.avg(value).over(w)
    got = {"mean": mean, "sum": F.sum(value).over(w), "zscore": ratio(F.col(value) - mean, F.stddev_pop(value).over(w))}[of]
    return df.withColumn(out, F.when(F.count(value).over(w) == window, got))


def _years(n: int, cadence: str | None) -> int:
    return n * YEAR.get(cadence or "", 12)


TRANSFORMS: dict[str, Callable] = {
    "raw": _raw,
    "diff": _diff,
    "pct_change": _change,
    "mom_1p": _change,
    "mom_3p": partial(_change, periods=3),
    "yoy_1y": partial(_change, periods=partial(_years, 1)),
    "yo2y": partial(_change, periods=partial(_years, 2)),
    "rolling_mean_3": partial(_rolling, window=3),
    "rolling_mean_6": partial(_rolling, window=6),
    "rolling_sum_3": partial(_rolling, window=3, of="sum"),
    "rolling_sum_12": partial(_rolling, window=12, of="sum"),
    "zscore_12": partial(_rolling, window=12, of="zscore"),
    "zscore_24": partial(_rolling, window=24, of="zscore"),
}
#: What a predictor without a list of its own is tried with.
DEFAULT_MENU = ("raw", "yoy_1y", "mom_3p", "rolling_mean_3", "zscore_12")


def apply_transform(df: DataFrame, name: str, *, out: str | None = None, keys=KEYS, date: str = DATE, value: str = VALUE, cadence: str | None = "monthly") -> DataFrame:
    """``df`` with a column ``out`` (the transform's name, if not given); KeyError for an unknown name.

    All transforms of a frame use one window, so any number of them takes one shuffle and one sort.
    """
    if name not in TRANSFORMS:
        raise KeyError(f"unknown transform {name!r}; there are {', '.join(sorted(TRANSFORMS))}")
    return TRANSFORMS[name](df, out or name, keys, date, value, cadence)
