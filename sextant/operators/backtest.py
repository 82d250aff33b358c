"""Scoring predictors against a target: panels of metrics, lead and lag, degradation, the best feature, walk-forward windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.columns import average_rank, both, pearson, ratio


def kpi_metrics(pairs: DataFrame, by: list[str], p: str = "p", t: str = "t") -> DataFrame:
    """One row for each group of pairs: n, corr, rank_corr, directional_accuracy, mae, mape, rmse, hit_rate.

    Over complete pairs only. mape is there if all targets are positive; correlations need three pairs.
    """
    rows = pairs.select(*by, *(c.alias(n) for c, n in zip(both(p, t), ("p", "t"), strict=True))).where("p is not null")
    ranked = rows.withColumn("rp", average_rank("p", by)).withColumn("rt", average_rank("t", by))
    e = F.col("p") - F.col("t")
    hit = F.avg((F.signum("p") == F.signum("t")).cast("double"))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pearson("p", "t").alias("corr"), pearson("rp", "rt").alias("rank_corr"), hit.alias("directional_accuracy"), F.avg(F.abs(e)).alias("mae"),
        F.when(F.min("t") > 0, F.avg(F.abs(ratio(e, "t"))) * 100).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), hit.alias("hit_rate"),
    )


def lead_lag_profile(pairs: DataFrame, by: list[str], lags=range(7), date: str = "obs_date", p: str = "p", t: str = "t") -> DataFrame:
    """Correlation of the predictor k rows before with the target, for each group and k; rounded to 4 digits."""
    w = Window.partitionBy(*by).orderBy(date)
    moved = pairs.select(*by, date, t, *((F.lag(p, k) if k >= 0 else F.lead(p, -k)).over(w).alias(f"p{k}") for k in lags))
    wide = moved.groupBy(*by).agg(*(pearson(f"p{k}", t).alias(f"r{k}") for k in lags))
    return wide.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.bround(f"r{k}", 4).alias("corr")) for k in lags))).alias("x")).select(*by, "x.*")


def oos_degradation(train: Column, test: Column) -> Column:
    """Per cent of the train correlation that the test correlation lacks; null for a train correlation of 0."""
    return F.bround(ratio(train - test, train) * 100, 2)


def survives(train: Column, test: Column) -> Column:
    """A test correlation of 0.1 at least, of the same sign, with half of the train correlation lost at most."""
    lost = oos_degradation(train, test)
    return F.coalesce((F.abs(test) >= 0.1) & ((F.signum(train) == F.signum(test)) | (train == 0)) & (lost.isNull() | (lost <= 50)), F.lit(False))


def score_features(grid: DataFrame, target: DataFrame, train: tuple, test: tuple) -> DataFrame:
    """A row for each feature: ordinal, r_train, n_train, r_test, n_test, degradation, survives, and its rank by absolute train correlation.

    ``target`` (obs_date, value) is joined once; both periods, inclusive, are conditions of one aggregation.
    """
    rows = grid.join(target.select("obs_date", F.col("value").alias("t")), "obs_date")
    inside = lambda period: F.col("obs_date").between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date"))
    whole = F.col("value").isNotNull() & F.col("t").isNotNull()
    scored = rows.groupBy("feature_id", "ordinal").agg(
        pearson("value", "t", inside(train)).alias("r_train"), F.count(F.when(inside(train) & whole, 1)).alias("n_train"), pearson("value", "t", inside(test)).alias("r_test"), F.count(F.when(inside(test) & whole, 1)).alias("n_test"),
    )
    scored = scored.withColumn("oos_degradation_pct", oos_degradation(F.col("r_train"), F.col("r_test"))).withColumn("survives_oos", survives(F.col("r_train"), F.col("r_test")))
    # the features of one signal are a short list (max_features), so one window over all of them is small
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("r_train").desc_nulls_last(), "ordinal")))


def walk_forward_windows(dates: DataFrame, *, min_train: int, step: int, date: str = "obs_date", by: list[str] | None = None) -> DataFrame:
    """Expanding windows over distinct dates: train from the first to the row before, test the next ``step`` rows."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(date)
    rows = dates.select(*by, date).distinct().withColumn("rn", F.row_number().over(w)).withColumn("train_start", F.first(date).over(w)).withColumn("train_end", F.lag(date).over(w)).withColumn("test_end", F.lead(date, step - 1).over(w))
    got = rows.where((F.col("rn") > min_train) & ((F.col("rn") - 1 - min_train) % step == 0) & F.col("test_end").isNotNull())
    return got.select(*by, "train_start", "train_end", F.col(date).alias("test_start"), "test_end")
