"""Studies from files to files: result tables as CSV folders and a summary in Markdown; and single analyses of a table's columns."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import analogues, cointegration, events, kernels, quality, statistics, studies, vintage, wide


class ArgumentsError(ValueError):
    """An analysis that lacks an argument or a column."""


def write_tables(folder: str, tables: dict[str, DataFrame], title: str, shown: int = 30) -> dict[str, list[dict[str, Any]]]:
    """Each result table (a row a trial) as ``folder``/name.csv with a header, one file each, and summary.md with their first rows."""
    lines, first = [f"# {title}", ""], {}
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
        rows = df.sparkSession.read.option("header", True).csv(f"{folder}/{name}.csv").limit(shown).collect()
        first[name] = [r.asDict() for r in rows]
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in rows), ""]
    Path(folder, "summary.md").write_text("\n".join(lines))
    return first


def revision_study(vintages: DataFrame, folder: str, *, split: str, horizons=studies.HORIZONS, units=studies.UNITS, primary=("growth_rev", 90), reps: int = 2000) -> dict:
    """Momentum trials and persistence of signs of revisions, over timely observations."""
    timely = vintage.timely(vintages)
    pairs = studies.momentum_pairs(timely, horizons=horizons, units=units)
    table = vintage.revisions(timely, primary[1])
    tables = {"momentum": studies.momentum_trials(pairs, split=split, primary=primary, reps=reps), "sign-persistence": studies.sign_persistence(table, primary[0], reps=reps)}
    return write_tables(folder, tables, "Momentum of revisions")


def reference_class_study(corpus: DataFrame, folder: str, *, like: str | None = None, filters: dict[str, str] | None = None) -> dict:
    """Base rates of classes and leave-one-out calibration; with ``like``, that event's analogues; ``filters`` choose the events that classes are of."""
    chosen = corpus
    for name, value in (filters or {}).items():
        if name not in corpus.columns:
            raise ArgumentsError(f"the corpus has no column {name}")
        chosen = chosen.where(F.lower(name) == value.lower())
    tables = {"class-base-rates": analogues.class_base_rates(chosen, ["disease_area", "moa"]), "calibration": analogues.leave_one_out(corpus)}
    if like is not None:
        one = corpus.where(F.col("event_id") == like)
        if one.isEmpty():
            raise ArgumentsError(f"the corpus has no event {like}")
        tables["analogues"] = analogues.retrieve(one, corpus).orderBy(F.desc("score"), "event_id")
    return write_tables(folder, tables, "Reference classes")


def family_study(pairs: DataFrame, folder: str, *, lags: list[int], train_end: str) -> dict:
    """Every term at every lag, corrected for their number."""
    return write_tables(folder, {"family": studies.family_test(pairs, lags, train_end)}, "A family of predictors")


def sell_the_news_study(features: DataFrame, folder: str, *, by: list[str] | None = None, reps: int = 2000) -> dict:
    """The cross-section of events by run-up, and the events' features; groups of all events, or by columns of the features."""
    keyed = features if by else features.withColumn("family", F.lit("all"))
    found = events.sell_the_news(keyed, by or ["family"], reps=reps)
    if found.isEmpty():
        raise ArgumentsError(f"no group has {events.LEAST_EVENTS} events with run-up and drift")
    return write_tables(folder, {"cross-section": found, "event-features": features.orderBy("catalyst_date", "event_id")}, "Selling the news")


# Single analyses of columns of one table, by the name of the mode: what they need, and what they give.


def _array(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Complete rows of a few columns of one series, in the order of ``date``."""
    rows = df.select("date", *columns).dropna().orderBy("date").toPandas()
    return [rows[c].to_numpy(float) for c in columns]


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.lit("series").alias("series_id"), F.col("date").alias("obs_date"), F.col(x).alias("p"), F.col(y).alias("t"))


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _granger(df: DataFrame, x: str, y: str) -> dict:
    return {"p": kernels.granger(*_array(df, x, y))}


def _quality(df: DataFrame) -> dict:
    """Missing values of all fields, and outliers of those that are numbers by their first rows, by date."""
    key = "date" if "date" in df.columns else df.columns[0]
    missing, far = quality.audit(df, key, [key])
    return {"missing": _rows(missing), "outliers": _rows(far.orderBy("field", key))}


def _numbers(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "double"]


def _long(df: DataFrame) -> DataFrame:
    """Every column of numbers as a series by date."""
    return df.select(F.col("date").alias("obs_date"), F.explode(F.array(*(F.struct(F.lit(c).alias("series_id"), F.col(c).alias("value")) for c in _numbers(df)))).alias("x")).select("x.series_id", "obs_date", "x.value")


MODES: dict[str, tuple[tuple[str, ...], Callable[..., Any]]] = {
    "correlation": (("x", "y"), lambda df, x, y: _rows(studies.lag_stability(_pairs(df, x, y), [0]).drop("series_id", "best"))[0]),
    "regression": (("x", "y"), lambda df, x, y: kernels.ols_hac((v := _array(df, x, y))[0][:, None], v[1])),
    "lags": (("x", "y"), lambda df, x, y: _rows(studies.lag_stability(_pairs(df, x, y), [1, 2, 5, 10, 20]).orderBy("lag").drop("series_id"))),
    "distance": (("x", "y"), lambda df, x, y: {"dcor": _rows(statistics.distance_correlation(_pairs(df, x, y), ["series_id"]))[0]["dcor"], "rolling": _rows(studies.rolling_distance_correlation(_pairs(df, x, y), 60).agg(F.min("dcor").alias("min"), F.avg("dcor").alias("mean"), F.max("dcor").alias("max")))[0]}),
    "granger": (("x", "y"), _granger),
    "cointegration": (("x", "y"), lambda df, x, y: dict(zip(("stat", "p"), kernels.engle_granger(*_array(df, x, y)), strict=True))),
    "stationarity": (("x",), lambda df, x: kernels.stationarity(_array(df, x)[0])),
    "decomposition": (("x",), lambda df, x: kernels.strength(kernels.stl(_array(df, x)[0], 12))),
    "quality": ((), _quality),
    "components": ((), lambda df: _rows(wide.principal_components(df, _numbers(df)).orderBy("component", "column"))),
    "correlations": ((), lambda df: _rows(wide.correlation_matrix(df, _numbers(df)).orderBy("a", "b"))),
    "pairs": ((), lambda df: _rows(cointegration.all_pairs(_long(df)).orderBy("a", "b"))),
}


def analyse(df: DataFrame, mode: str, **columns: str | None) -> Any:
    """What a mode gives for the named columns of ``df``, a series by ``date``."""
    if mode not in MODES:
        raise ArgumentsError(f"no mode {mode}; there are {', '.join(MODES)}")
    needed, run = MODES[mode]
    if missing := [n for n in needed if not columns.get(n)]:
        raise ArgumentsError(f"{mode} needs --{' --'.join(missing)}")
    if missing := [c for c in ("date", *(columns[n] for n in needed)) if c not in df.columns and (needed or c != "date")]:
        raise ArgumentsError(f"the table has no column {', '.join(missing)}")
    return run(df, **{n: columns[n] for n in needed})


def read_table(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    """A CSV file of numbers by date; what is no number is null."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*(F.expr(f"try_cast(`{c}` as date)").alias("date") if c == date else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in df.columns))
