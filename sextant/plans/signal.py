"""From a spec and series to a verdict: rollup, grid, scores, the verdict of the best feature, and the files of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.transforms import apply_transform
from sextant.operators import validation as V
from sextant.operators.backtest import score_features
from sextant.operators.grid import Predictor, assess_search, build_grid, plan_features
from sextant.operators.rollup import apply_release_lag, rollup, rollup_audit
from sextant.operators.verdicts import DECLARED, as_checks, judge
from sextant.operators.vintage import first_vintage
from sextant.plans import render
from sextant.sources.files import read_series, read_vintages
from sextant.sources.specs import SignalSpec


@dataclass
class RunSummary:
    signal_id: str
    best_feature: str
    train: dict[str, Any]
    test: dict[str, Any]
    lead_lag: dict[int, float | None]
    oos_degradation_pct: float | None
    survives_oos: bool
    checks: list[V.Check]
    relationship: tuple[str, str]
    gate: dict[str, Any]
    search: dict[str, Any]
    audits: list[dict[str, Any]]
    features: list[dict[str, Any]]
    recommendations: list[str] = field(default_factory=list)
    run_dir: str | None = None


def period(text: str) -> tuple[str, str]:
    a, _, b = text.partition("/")
    return a.strip(), b.strip()


def run_signal(spark: SparkSession, spec: SignalSpec, target: DataFrame, predictors: DataFrame, *, run_dir: str | None = None, registry_commit: str | None = None, vintage_handled: bool | None = None, vintage_source: str | None = None) -> RunSummary:
    """The verdict on ``spec`` over ``target`` (obs_date, value) and long ``predictors`` (series_id, obs_date, value).

    All features are scored in one job; what comes to the driver are their scores, and the pairs of the best one (a rolled-up
    series), for the page of the run. The verdict is that of verdicts.judge, for one signal.
    """
    rolled, audits = None, []
    target = target.select(F.lit(spec.target.dataset_id).alias("series_id"), "obs_date", "value")
    if spec.target.transform:
        target = apply_transform(target, spec.target.transform, out="_t", cadence=spec.target.cadence).select("series_id", "obs_date", F.col("_t").alias("value"))
    for p in spec.predictors:
        rows = predictors.where(F.col("series_id") == p.dataset_id)
        rows = apply_release_lag(rows, p.release_lag_days) if p.release_lag_days else rows
        options = {"source": p.cadence, "target": spec.target.cadence, "variable_type": p.variable_type, "how": p.default_aggregation, "overridden": p.aggregation_overridden}
        got = rollup(rows, **options)
        audits += [r.asDict() for r in rollup_audit(rows, got, **options).collect()]
        rolled = got if rolled is None else rolled.unionByName(got)
    features, cut = plan_features([Predictor(p.dataset_id, p.transforms, p.lags) for p in spec.predictors], spec.max_features, spec.max_lags)
    grid = build_grid(rolled, features, spec.target.cadence)
    train, test = period(spec.train_period), period(spec.test_period)
    scores = [r.asDict() for r in score_features(grid, target, train, test).orderBy("rank").collect()]
    scores = [s for s in scores if s["r_train"] is not None]
    if not scores:
        raise ValueError("every correlation was null: do the dates of target and predictors meet?")
    best = scores[0]
    pairs = grid.where(F.col("feature_id") == best["feature_id"]).join(target.select("obs_date", F.col("value").alias("t")), "obs_date").select("obs_date", F.col("value").alias("p"), "t")
    part = F.when(F.col("obs_date").between(*(F.lit(x).cast("date") for x in train)), "train").when(F.col("obs_date").between(*(F.lit(x).cast("date") for x in test)), "test")
    pairs = pairs.withColumn("part", part).where("part is not null")
    rows = pairs.orderBy("obs_date").collect()
    pairs = spark.createDataFrame(rows, pairs.schema).withColumn("signal_id", F.lit(spec.signal_id))
    pre = spec.pre_specified_feature == best["feature_id"]
    search = assess_search(len(features), len({f.lag for f in features}), pre_specified=pre, out_of_sample=best["survives_oos"]) | {"truncated": cut}
    said = {"signal_id": spec.signal_id, "features_tested": len(features), "pre_specified": pre, "direction": spec.hypothesis.get("expected_direction"), "feature": best["feature_id"], "confidence_cap": search["confidence_cap"], "revised": bool(spec.target.revised), "vintage_handled": vintage_handled, "vintage_source": vintage_source, "regime_split": bool(spec.regime_split), "walk_forward": bool(spec.walk_forward)}
    signals = spark.createDataFrame([said], "signal_id string, " + ", ".join(f"{n} {kind}" for n, (kind, _) in DECLARED.items()))
    verdicts, checked = judge(pairs, signals)
    v, checks = verdicts.first(), as_checks(checked.collect())
    metrics = lambda part: part.asDict() if part else {}
    kind, verdict, survives = (v.relationship, v.justification), {"confidence_cap": v.confidence_cap, "binding_constraint": v.binding_constraint}, v.survives_oos
    summary = RunSummary(spec.signal_id, best["feature_id"], metrics(v.train), metrics(v.test), v.lead_lag or {}, best["oos_degradation_pct"], survives, checks, kind, verdict, search, audits, scores, v.recommendations, run_dir)
    if run_dir:
        render.write_run(Path(run_dir), spec, summary, registry_commit, [(r["obs_date"], r["p"], r["t"]) for r in rows])
    return summary


def run_signal_from_paths(spark: SparkSession, spec: SignalSpec, predictors: dict[str, str], *, target_path: str | None = None, target_vintages: str | None = None, date: str = "date", value: str = "value", **options) -> RunSummary:
    """The same from CSV files: the target as final values or, as first released, from vintages; one of the two."""
    if (target_path is None) == (target_vintages is None):
        raise ValueError("give the target's file or its vintages")
    if target_vintages:
        target = first_vintage(read_vintages(spark, target_vintages, spec.target.dataset_id)).select("obs_date", "value")
        options |= {"vintage_handled": True, "vintage_source": target_vintages}
    else:
        target = read_series(spark, target_path, spec.target.dataset_id, date, value)
    series = None
    for name, path in predictors.items():
        got = read_series(spark, path, name, date, value)
        series = got if series is None else series.unionByName(got)
    return run_signal(spark, spec, target, series, **options)
