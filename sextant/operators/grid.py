"""The feature grid in long form: predictor x transform x lag, and the account of how much was searched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.transforms import DEFAULT_MENU, apply_transform

CEILING = 50


@dataclass(frozen=True)
class Predictor:
    """A series to be tried, with its transforms (the default menu, if none) and lags."""

    dataset_id: str
    transforms: tuple[str, ...] = ()
    lags: tuple[int, ...] = (0,)


@dataclass(frozen=True)
class Feature:
    name: str
    series_id: str
    transform: str
    lag: int
    ordinal: int


def plan_features(predictors: list[Predictor], max_features: int = 40, max_lags: int = 3) -> tuple[list[Feature], bool]:
    """The features in declaration order, all predictors with the union of all lags up to ``max_lags``; whether the list was cut at ``max_features``."""
    lags = sorted({k for p in predictors for k in p.lags if k <= max_lags})
    every = [(p.dataset_id, t, k) for p in predictors for t in (p.transforms or DEFAULT_MENU) for k in lags]
    return [Feature(f"{d}::{t}::lag_{k}", d, t, k, n) for n, (d, t, k) in enumerate(every[:max_features])], len(every) > max_features


def build_grid(series: DataFrame, features: list[Feature], cadence: str | None = "monthly") -> DataFrame:
    """Rows of (feature_id, ordinal, obs_date, value) from long ``series`` (series_id, obs_date, value).

    All transforms are columns of one window pass, then unpivoted; lags are one more window over the same partitioning. Features
    are rows: more of them add no plan nodes.
    """
    names = list(dict.fromkeys(f.transform for f in features))
    wide = series.select("series_id", "obs_date", "value")
    for n in names:
        wide = apply_transform(wide, n, out=f"t_{n}", cadence=cadence)
    spark = series.sparkSession
    listed = spark.createDataFrame([(f.series_id, f.transform, f.lag, f.name, f.ordinal) for f in features], "series_id string, transform string, lag int, feature_id string, ordinal int")
    long = wide.select("series_id", "obs_date", F.explode(F.array(*(F.struct(F.lit(n).alias("transform"), F.col(f"t_{n}").alias("value")) for n in names))).alias("x")).select("series_id", "obs_date", "x.*")
    order = Window.partitionBy("series_id", "transform").orderBy("obs_date")
    numbered = long.withColumn("rn", F.row_number().over(order))
    # value at date row n for lag k is the value of row n-k: move rows ahead by their lag and meet the dates there
    dates = numbered.select("series_id", "transform", "rn", "obs_date")
    moved = numbered.join(F.broadcast(listed), ["series_id", "transform"]).select("series_id", "transform", "feature_id", "ordinal", (F.col("rn") + F.col("lag")).alias("rn"), "value")
    return moved.join(dates, ["series_id", "transform", "rn"]).select("feature_id", "ordinal", "obs_date", "value")


def assess_search(n_features: int, n_lags: int, *, pre_specified: bool, out_of_sample: bool | None) -> dict:
    """How much was searched, and the confidence that this allows at most."""
    size = n_features * n_lags
    cap = "high" if pre_specified else "low" if out_of_sample is False else "medium" if size > CEILING or out_of_sample is None else "high"
    return {"features_tested": n_features, "grid_size": size, "pre_specified": pre_specified, "out_of_sample": out_of_sample, "confidence_cap": cap}
