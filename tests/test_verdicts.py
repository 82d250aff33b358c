"""Verdicts on many signals: rows of checks against the checks of one, the gate as an aggregate, and published vectors through the grouped pass."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import validation, verdicts


def month(k):
    return dt.date(2010 + k // 12, k % 12 + 1, 1)


def frames(spark, cases):
    """Pairs and signals of {name: (p, t, what is declared)}; months are dealt unsorted."""
    rows = [(name, month(k), "test" if k >= len(p) // 2 else "train", None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for name, (p, t, _) in cases.items() for k, (a, b) in enumerate(zip(p, t, strict=True))]
    pairs = spark.createDataFrame(rows[::-1], "signal_id string, obs_date date, part string, p double, t double").repartition(3)
    fields = ", ".join(f"{n} {kind}" for n, (kind, _) in verdicts.DECLARED.items())
    signals = spark.createDataFrame([{"signal_id": name, **said} for name, (_, _, said) in cases.items()], f"signal_id string, {fields}")
    return pairs, signals


@pytest.fixture(scope="module")
def cases():
    r = np.random.default_rng(7)
    x = r.normal(size=240)
    walk = r.normal(size=240).cumsum()
    flip = np.where(np.arange(240) < 180, x, -x)
    holes = x.copy()
    holes[[121, 130, 200]] = np.nan
    return {
        "strong": (x, x + r.normal(0, 0.3, 240), {"features_tested": 4, "regime_split": True}),
        "noise": (r.normal(size=240), x, {"features_tested": 4, "revised": True}),
        "walk": (walk, walk + r.normal(size=240), {"features_tested": 1, "pre_specified": True, "direction": "positive", "walk_forward": False}),
        "flip": (x, flip, {"features_tested": 2, "regime_split": True, "vintage_handled": True, "vintage_source": "v"}),
        "holes": (holes, x + 0.5, {}),
        "short": (x[:8], x[:8], {"features_tested": 2, "confidence_cap": "medium"}),
        "constant": (np.ones(60), x[:60], {"features_tested": 2}),
    }


def test_every_signal_gets_its_checks(spark, cases):
    pairs, signals = frames(spark, cases)
    judged, checks = verdicts.judge(pairs, signals.union(signals.limit(1).withColumn("signal_id", F.lit("nothing"))), keep=lambda df: df.cache())
    rows = {k: [r for r in checks.collect() if r.signal_id == k] for k in [*cases, "nothing"]}
    out = {r.signal_id: r for r in judged.collect()}
    assert set(out) == set(rows)
    for name, (p, t, said) in cases.items():
        own = {n: said.get(n, default) for n, (_, default) in verdicts.DECLARED.items()}
        half = len(p) // 2
        wanted, kind = validation.checks_of(p[half:], t[half:], split=own["regime_split"], survives=out[name].survives_oos, **{n: own[n] for n in ("features_tested", "pre_specified", "feature", "revised", "vintage_handled", "vintage_source")})
        assert [c.as_dict() for c in verdicts.as_checks(rows[name])] == [c.as_dict() | {"threshold": None if c.threshold is None else float(c.threshold)} for c in wanted], name
        assert (out[name].relationship, out[name].justification) == kind
        capped = validation.gate(wanted, own, survives_oos=out[name].survives_oos, walk_forward=own["walk_forward"])
        assert (out[name].confidence_cap, out[name].binding_constraint) == tuple(capped.values()), name
        advice = [f"{c.name}: {c.explanation}" for c in wanted if c.verdict != "pass"]
        assert out[name].recommendations == advice + [] if out[name].survives_oos else [*advice, "do not use: the relationship is not there out of sample"]
        assert out[name].lead_lag == validation.profile_of(p[half:], t[half:])
    assert out["strong"].survives_oos and out["strong"].relationship == "coincident" and not out["noise"].survives_oos
    assert out["nothing"].confidence_cap == "low" and out["nothing"].test is None and not out["nothing"].survives_oos
    assert "revisions" in [r.check for r in rows["noise"]] and next(r.verdict for r in rows["flip"] if r.check == "revisions") == "pass"


def test_survival_by_p_values(spark):
    """The direction that was expected halves the p-value; features tested multiply it."""
    rows = [(0.4, 20, True, "positive", 1, True), (0.4, 20, True, "negative", 1, False), (0.4, 20, False, None, 1, False), (0.6, 20, False, None, 5, True), (0.6, 20, False, None, 50, False), (0.9, 3, False, None, 50, True), (None, 0, True, None, 1, True)]
    df = spark.createDataFrame(rows, "r double, n long, pre_specified boolean, direction string, features_tested int, want boolean")
    df = df.withColumn("p", verdicts.p_values("r", F.col("n").cast("double")))
    assert [x.got == x.want for x in df.select("want", verdicts.holds(F.lit(True), F.col("p"), F.col("r"), F.col("n")).alias("got")).collect()] == [True] * len(rows)
    assert not df.select(verdicts.holds(F.lit(False), F.col("p"), F.col("r"), F.col("n")).alias("got")).where("got").count()


def test_published_vectors_of_the_checks():
    """White noise, a random walk, an autoregression and planted outliers, from the seeds that the published vectors have."""
    noise = lambda seed: np.random.default_rng(seed).normal(0, 1, 200)
    assert validation.stationarity_adf(noise(0)).verdict == "pass" and validation.stationarity_adf(noise(0).cumsum()).verdict == "warn"
    assert validation.stationarity_kpss(noise(1)).verdict == "pass" and validation.stationarity_kpss(noise(1).cumsum()).verdict == "warn"
    assert validation.stationarity_adf(np.array([1.0, 2.0, 3.0])).verdict == "warn"
    e, v = np.random.default_rng(3).normal(0, 1, 200), np.zeros(200)
    for i in range(1, 200):
        v[i] = 0.9 * v[i - 1] + e[i]
    assert validation.autocorrelation(noise(2)).verdict == "pass" and validation.autocorrelation(v).verdict == "warn"
    r = np.random.default_rng(4)
    x = r.normal(0, 1, 200)
    assert validation.outlier_sensitivity(x, x + r.normal(0, 0.2, 200)).verdict == "pass"
    r = np.random.default_rng(5)
    x, y = r.normal(0, 1, 200), r.normal(0, 1, 200)
    x[:3] = y[:3] = 20, 21, 22
    assert validation.outlier_sensitivity(x, y, share=0.02).verdict == "warn"
    assert validation.lag_sensitivity({}).verdict == "warn"
