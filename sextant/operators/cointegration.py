"""Cointegration of every two series: series are dealt to tiles, and two tiles meet in a group.

A series is sent once for each tile, not once for each partner, and a group holds the series of two tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import kernels

#: Series of a tile, about.
TILE_SERIES = 256

RESULT = "a string, b string, n long, slope double, stat double, p double, trace array<double>, rank int"


def tested(a: np.ndarray, b: np.ndarray, lags: int | None, differences: int) -> tuple:
    """Of one pair: slope of a on b, Engle and Granger's statistic and p-value, Johansen's trace statistics, and the rank they give at 95 %."""
    coef, rest, _ = kernels.ols(np.column_stack([b, np.ones(len(b))]), a)
    if lags is None:
        stat, p = kernels.adf(rest, constant=False, series=2)[:2]
    else:
        stat = kernels.adf_fit(rest, lags, len(rest) - 1 - lags, False)[0]
        p = kernels.unit_root_p(stat, 2)
    traces = kernels.johansen(np.column_stack([a, b]), differences)
    rank = next((t["rank"] for t in traces if t["trace"] <= t["critical_95"]), len(traces))
    return float(coef[0]), stat, p, [t["trace"] for t in traces], rank


def all_pairs(series: DataFrame, *, lags: int | None = None, differences: int = 1, least: int = 20, tile_series: int = TILE_SERIES) -> DataFrame:
    """RESULT for every two series of (series_id, obs_date, value), a before b in order of their names, over the dates that both have.

    ``lags`` of the residuals' differences, or as many as the information criterion chooses; ``differences`` are the lagged ones of
    Johansen's test. Nulls are left out; pairs with fewer than ``least`` dates in common, or of a constant, are too. Dates of a series are unique.
    """
    rows = series.where("value is not null").select("series_id", "obs_date", F.col("value").cast("double").alias("value"))
    held = rows.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("obs_date").alias("day"), "value"))).alias("v"))
    tiles = max(1, math.ceil(rows.select("series_id").distinct().count() / tile_series))
    dealt = held.select("series_id", F.pmod(F.xxhash64("series_id"), F.lit(tiles)).cast("int").alias("tile"), F.col("v.day").alias("days"), F.col("v.value").alias("values"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))

    def run(rows: pa.Table) -> pa.Table:
        found = []
        known = [(i, t, np.array(d), np.array(v)) for i, t, d, v in zip(rows["series_id"].to_pylist(), rows["tile"].to_pylist(), rows["days"].to_pylist(), rows["values"].to_pylist(), strict=True)]
        known.sort(key=lambda x: x[0])
        one_tile = rows["left"][0].as_py() == rows["right"][0].as_py()
        for k, (i, tile, days, values) in enumerate(known):
            for j, other, their, theirs in known[k + 1 :]:
                if tile == other and not one_tile:
                    continue
                _, at, to = np.intersect1d(days, their, assume_unique=True, return_indices=True)
                a, b = values[at], theirs[to]
                if len(a) >= least and np.ptp(a) and np.ptp(b):
                    found.append((i, j, len(a), *tested(a, b, lags, differences)))
        columns = list(zip(*found, strict=True)) or [()] * 8
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "n", "slope", "stat", "p", "trace", "rank"])

    met = dealt.select(F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "series_id", "tile", "days", "values")
    return met.groupBy("left", "right").applyInArrow(run, RESULT)
