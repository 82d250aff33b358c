"""Signal and hypothesis documents: typed records, loaded from YAML and checked."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from sextant.functions.periods import AGGREGATION, AGGREGATIONS, CADENCES
from sextant.functions.transforms import TRANSFORMS


class SpecError(ValueError):
    """What is wrong with a document, and where."""


@dataclass(frozen=True)
class Target:
    dataset_id: str
    cadence: str
    field: str | None = None
    transform: str | None = None
    revised: bool | None = None


@dataclass(frozen=True)
class PredictorSpec:
    dataset_id: str
    cadence: str
    variable_type: str
    field: str | None = None
    default_aggregation: str | None = None
    aggregation_overridden: bool = False
    release_lag_days: int = 0
    transforms: tuple[str, ...] = ()
    lags: tuple[int, ...] = (0,)


@dataclass(frozen=True)
class SignalSpec:
    signal_id: str
    signal_name: str
    target: Target
    predictors: tuple[PredictorSpec, ...]
    train_period: str
    test_period: str
    hypothesis: dict[str, Any] = field(default_factory=dict)
    walk_forward: bool = False
    regime_split: bool = False
    max_features: int = 40
    max_lags: int = 3
    pre_specified_feature: str | None = None
    outputs: dict[str, Any] = field(default_factory=dict)


def _need(d: dict, where: str, *keys: str) -> None:
    for k in keys:
        if d.get(k) in (None, "", []):
            raise SpecError(f"{where}: {k} is missing")


def _one_of(value: str | None, allowed, where: str) -> None:
    if value is not None and value not in allowed:
        raise SpecError(f"{where}: {value!r} is none of {', '.join(allowed)}")


def parse_signal(d: dict) -> SignalSpec:
    _need(d, "signal", "signal_id", "target", "predictors", "validation")
    if not re.fullmatch(r"[a-z0-9-]+", str(d["signal_id"])):
        raise SpecError(f"signal: signal_id {d['signal_id']!r} is not lower case with dashes")
    t = d["target"]
    _need(t, "target", "dataset_id", "cadence")
    _one_of(t["cadence"], CADENCES, "target.cadence")
    _one_of(t.get("transform"), TRANSFORMS, "target.transform")
    predictors = []
    for n, p in enumerate(d["predictors"]):
        where = f"predictors[{n}]"
        _need(p, where, "dataset_id", "cadence")
        _one_of(p["cadence"], CADENCES, f"{where}.cadence")
        _one_of(p.get("variable_type"), AGGREGATION, f"{where}.variable_type")
        _one_of(p.get("default_aggregation"), AGGREGATIONS, f"{where}.default_aggregation")
        for name in p.get("transforms") or ():
            _one_of(name, TRANSFORMS, f"{where}.transforms")
        predictors.append(PredictorSpec(p["dataset_id"], p["cadence"], p.get("variable_type", "flow"), p.get("field"), p.get("default_aggregation"), bool(p.get("aggregation_overridden")), int(p.get("release_lag_days") or 0), tuple(p.get("transforms") or ()), tuple(p.get("lags") or (0,))))
    v, g = d["validation"], d.get("feature_grid") or {}
    _need(v, "validation", "train_period", "test_period")
    for k in ("train_period", "test_period"):
        if "/" not in str(v[k]):
            raise SpecError(f"validation.{k}: {v[k]!r} is not start/end")
    return SignalSpec(
        d["signal_id"], d.get("signal_name", d["signal_id"]), Target(t["dataset_id"], t["cadence"], t.get("field"), t.get("transform"), t.get("revised")), tuple(predictors), v["train_period"], v["test_period"], d.get("hypothesis") or {},
        bool(v.get("walk_forward")), bool(v.get("regime_split")), int(g.get("max_features", 40)), int(g.get("max_lags", 3)), g.get("pre_specified_feature"), d.get("outputs") or {},
    )


def load_signal(path: str | Path) -> SignalSpec:
    return parse_signal(yaml.safe_load(Path(path).read_text()))


def load_hypothesis(path: str | Path) -> dict[str, Any]:
    d = yaml.safe_load(Path(path).read_text())
    _need(d, "hypothesis", "hypothesis_id", "statement", "target_variable")
    if not re.match(r"HYP-", str(d["hypothesis_id"])):
        raise SpecError("hypothesis: hypothesis_id does not begin with HYP-")
    return d


def load_weights(path: str | Path) -> dict[str, float]:
    """Weights of the axes of fitness, by name; the others keep theirs."""
    from sextant.operators.registry import WEIGHTS

    d = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(d, dict):
        raise SpecError("weights: not a map of axes")
    for name, value in d.items():
        _one_of(name, WEIGHTS, "weights")
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
            raise SpecError(f"weights.{name}: {value!r} is no weight")
    return {k: float(v) for k, v in d.items()}
