"""Studies over families of trials: momentum and persistence of revisions, predictors by lag, dependence over rolling windows.

A trial is a row: series, units, horizons, terms and lags are columns. P-values are taken of trials, of which there are far fewer than
observations; bootstraps are those of resampling, without resampled rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sextant.functions.columns import average_rank, pearson, ratio
from sextant.functions.special import normal_cdf
from sextant.operators import quality, statistics, vintage
from sextant.operators.resampling import bootstrap
from sextant.operators.verdicts import p_values

UNITS = ("growth_rev", "rel_level_rev")
HORIZONS = (30, 90, 180)


def p_of(r: str, n: str) -> Column:
    """The two-sided p-value of correlations ``r`` over ``n`` pairs; of trials, not of observations."""
    return p_values(F.col(r), F.col(n).cast("double"))


@pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """The two-sided p-values of normal scores."""
    return pd.Series([None if np.isnan(x) else 2 * (1 - normal_cdf(abs(x))) for x in z], dtype=float)


def momentum_pairs(vintages: DataFrame, *, horizons=HORIZONS, units=UNITS) -> DataFrame:
    """Pairs without look-ahead (see vintage.safe_pairs) of every series, unit and horizon, as one long frame."""
    keys = ["series_id", "horizon"]
    table = vintage.revisions(vintages.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))), F.col("horizon"), keys)
    long = table.select(*keys, "obs_date", "first_release_date", "knowable_date", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("revision")) for u in units))).alias("_u"))
    return vintage.safe_pairs(long.select(*keys, "obs_date", "first_release_date", "knowable_date", "_u.*"), "revision", [*keys, "unit"])


def momentum_trials(pairs: DataFrame, *, split: str, primary: tuple[str, int] = ("growth_rev", 90), least: int = 8, alpha: float = 0.05, reps: int = 2000) -> DataFrame:
    """A row for each series, unit and horizon of ``least`` pairs or more: correlation of a revision with the last knowable one, in all and from ``split`` on.

    Bonferroni's correction is over the primary family alone, that of one unit and one horizon; one of them survives where its
    corrected p-value is below ``alpha`` and its bootstrap interval excludes zero.
    """
    keys = ["series_id", "unit", "horizon"]
    late = F.col("obs_date") >= F.lit(split).cast("date")
    counts = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("full_n"), F.count(F.when(late, 1)).alias("oos_n"), pearson("x", "y").alias("full_r"), pearson("x", "y", late, least=4).alias("oos_r")).where(F.col("full_n") >= least)
    limits = bootstrap(pairs, keys, "correlation", reps=reps)
    rows = counts.join(limits, keys).withColumn("primary", (F.col("unit") == primary[0]) & (F.col("horizon") == primary[1])).withColumn("full_p", p_of("full_r", "full_n")).withColumn("oos_p", p_of("oos_r", "oos_n"))
    family = counts.where((F.col("unit") == primary[0]) & (F.col("horizon") == primary[1])).agg(F.count(F.lit(1)).alias("_family"))  # one row
    rows = rows.crossJoin(F.broadcast(family)).withColumn("full_p_bonferroni", F.when(F.col("primary"), F.least(F.col("full_p") * F.col("_family"), F.lit(1.0)))).drop("_family")
    return rows.withColumn("primary_survives", F.coalesce((F.col("full_p_bonferroni") < alpha) & ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)), F.lit(False)))


def sign_persistence(table: DataFrame, unit: str = "growth_rev", *, by: list[str] | None = None, block: int = 12, reps: int = 2000) -> DataFrame:
    """For each series of two blocks or more: the share of revisions that go the way of the one before, its bootstrap interval, and the runs test with its p-value; zeros are left out."""
    by = by or ["series_id"]
    signs = table.where(F.col(unit).isNotNull() & (F.col(unit) != 0)).select(*by, "obs_date", F.col(unit).alias("value"))
    same = signs.withColumn("same", (F.signum("value") == F.lag(F.signum("value")).over(Window.partitionBy(*by).orderBy("obs_date"))).cast("double")).where("same is not null")
    share = same.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("same").alias("same_sign_share")).where(F.col("n_pairs") + 1 >= 2 * block)
    limits = bootstrap(same, by, "mean", x="same", y=None, block=block, reps=reps, low="share_ci_low", high="share_ci_high")
    runs = statistics.runs_test(signs, by).select(*by, "runs", "expected_runs", F.col("z").alias("runs_z"), two_sided("z").alias("runs_p"))
    return share.join(limits, by).join(runs, by)


def family_test(pairs: DataFrame, lags: list[int], train_end: str, *, alpha: float = 0.05, by: str = "term") -> DataFrame:
    """quality.family_matrix with p-values before and after ``train_end``, corrected for the number of trials, and what survives."""
    rows = quality.family_matrix(pairs, lags, train_end, by=by)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_trials"))))  # one row
    for side in ("train", "test"):
        rows = rows.withColumn(f"p_{side}", p_of(f"r_{side}", f"n_{side}")).withColumn(f"p_{side}_bonferroni", F.least(F.col(f"p_{side}") * F.col("_trials"), F.lit(1.0)))
        rows = rows.withColumn(f"survives_{side}", F.coalesce(F.col(f"p_{side}_bonferroni") < alpha, F.lit(False)))
    return rows.drop("_trials")


def _lagged(pairs: DataFrame, lags: list[int], by: list[str], date: str) -> DataFrame:
    """Complete pairs of the predictor ``lag`` rows before with the target, for each lag."""
    w = Window.partitionBy(*by).orderBy(date)
    wide = pairs.select(*by, date, "t", F.array(*(F.struct(F.lit(k).alias("lag"), F.lag("p", k).over(w).alias("p")) for k in lags)).alias("_x"))
    return wide.select(*by, date, "t", F.explode("_x").alias("_x")).select(*by, date, "t", "_x.*").where("p is not null and t is not null")


def lag_stability(pairs: DataFrame, lags: list[int], *, by: list[str] | None = None, window: int = 60, date: str = "obs_date") -> DataFrame:
    """For each lag: three correlations, t, p, n, the share of rolling correlations above zero, what that says, and whether the lag is its series' best.

    Rolling windows that aren't full count as not above zero. Best is the lag of the least p-value among those that are not unstable.
    """
    by = by or ["series_id"]
    keys = [*by, "lag"]
    moved = _lagged(pairs, lags, by, date)
    ranked = moved.withColumn("_rp", average_rank("p", keys)).withColumn("_rt", average_rank("t", keys))
    rolled = ranked.withColumn("_roll", pearson("p", "t", over=Window.partitionBy(*keys).orderBy(date).rowsBetween(-(window - 1), 0), least=window))
    got = rolled.groupBy(*keys).agg(pearson("p", "t").alias("r"), pearson("_rp", "_rt").alias("rho"), F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((F.col("_roll") > 0).cast("double"), F.lit(0.0))).alias("rolling_pct_positive"))
    got = got.join(statistics.distance_correlation(moved, keys).select(*keys, "dcor"), keys)
    share = F.col("rolling_pct_positive")
    got = got.withColumn("t_stat", ratio(F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0))), F.sqrt(F.greatest(1 - F.col("r") ** 2, F.lit(0.0))))).withColumn("p_value", p_of("r", "n"))
    got = got.withColumn("stability", F.when(share > 0.8, "stable").when(share > 0.6, "moderate").otherwise("unstable"))
    usable = F.when(F.col("stability") != "unstable", F.struct("p_value", "lag"))
    return got.withColumn("best", F.coalesce(F.min(F.when(F.col("p_value").isNotNull(), usable)).over(Window.partitionBy(*by))["lag"] == F.col("lag"), F.lit(False)))


@pandas_udf(DoubleType())
def _window_dcor(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance correlations of windows of one length."""
    out = np.full(len(a), np.nan)
    for at in range(0, len(a), 256):
        centred = []
        for side in (a, b):
            v = np.stack(side.iloc[at : at + 256].to_numpy())
            d = np.abs(v[:, :, None] - v[:, None, :])
            centred.append(d - d.mean(1, keepdims=True) - d.mean(2, keepdims=True) + d.mean((1, 2), keepdims=True))
        x, y = centred
        norm = np.sqrt((x * x).mean((1, 2)) * (y * y).mean((1, 2)))
        out[at : at + len(x)] = np.sqrt(np.clip(np.divide((x * y).mean((1, 2)), norm, out=np.zeros_like(norm), where=norm > 0), 0, None))
    return pd.Series(out)


def rolling_distance_correlation(pairs: DataFrame, window: int = 60, *, by: list[str] | None = None, date: str = "obs_date", a: str = "p", b: str = "t") -> DataFrame:
    """Rows (by, date, dcor): the distance correlation of the ``window`` rows before each row, itself left out; rows with fewer before them are left out."""
    by = by or ["series_id"]
    before = Window.partitionBy(*by).orderBy(date).rowsBetween(-window, -1)
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.select(*by, date, F.collect_list(F.col(a).cast("double")).over(before).alias("_a"), F.collect_list(F.col(b).cast("double")).over(before).alias("_b"))
    return rows.where(F.size("_a") == window).select(*by, date, _window_dcor("_a", "_b").alias("dcor"))
