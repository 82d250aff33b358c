"""Checks of one signal and the kind of its relationship, from its pairs as arrays; verdicts.check_rows runs them for every signal in its task."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np

from sextant.functions.special import correlation_p, deflated_correlation
from sextant.operators import kernels

PASS, WARN, FAIL = "pass", "warn", "fail"
TIER = {"low": 1, "medium": 2, "high": 3}
OF_VERDICT = {PASS: "high", WARN: "medium", FAIL: "low"}


@dataclass(frozen=True)
class Check:
    name: str
    verdict: str
    value: Any = None
    threshold: Any = None
    explanation: str = ""

    def as_dict(self) -> dict:
        return asdict(self)


def sample_size(n: int) -> Check:
    return Check("sample_size", PASS if n >= 120 else WARN if n >= 30 else FAIL, n, 120, f"{n} observations; {'limited' if n < 60 else 'moderate' if n < 120 else 'ample'} power")


def missingness(n: int, missing: int) -> Check:
    if not n:
        return Check("missingness", FAIL, 100.0, 25, "the series is empty")
    share = round(100 * missing / n, 2)
    return Check("missingness", FAIL if share >= 25 else WARN if share >= 5 else PASS, share, 25, f"{share} % of values are missing")


def outliers(values: np.ndarray, z: float = 4.0) -> Check:
    v = values[~np.isnan(values)]
    if len(v) < 4:
        return Check("outliers", WARN, None, z, "too few values")
    sd = v.std()
    count = int((np.abs(v - v.mean()) > z * sd).sum()) if sd > 0 else 0
    share = count / len(v)
    return Check("outliers", PASS if not count else WARN if share < 0.01 else FAIL, count, z, f"{count} values beyond {z} standard deviations")


def stationarity_adf(values: np.ndarray) -> Check:
    v = values[~np.isnan(values)]
    if len(v) < 20:
        return Check("stationarity_adf", WARN, None, 0.05, "too few values")
    p = round(kernels.adf(v)[1], 4)
    return Check("stationarity_adf", PASS if p < 0.05 else WARN, p, 0.05, "a unit root is rejected" if p < 0.05 else "a unit root is not rejected")


def stationarity_kpss(values: np.ndarray) -> Check:
    v = values[~np.isnan(values)]
    if len(v) < 20:
        return Check("stationarity_kpss", WARN, None, 0.05, "too few values")
    p = round(kernels.kpss(v)[1], 4)
    return Check("stationarity_kpss", PASS if p >= 0.05 else WARN, p, 0.05, "stationarity is not rejected" if p >= 0.05 else "stationarity is rejected")


def autocorrelation(values: np.ndarray) -> Check:
    v = values[~np.isnan(values)]
    lags = min(10, len(v) // 4)
    if lags < 1:
        return Check("autocorrelation", WARN, None, 0.05, "too few values")
    p = round(float(kernels.ljung_box(v, lags)[1]), 4)
    return Check("autocorrelation", WARN if p < 0.05 else PASS, p, 0.05, "serial correlation" if p < 0.05 else "no serial correlation found")


def bartlett_lags(n: int) -> int:
    return int(n ** (1 / 3))


def effective_n(a: np.ndarray, b: np.ndarray) -> float:
    n = len(a)
    if n < 10:
        return float(n)
    rho = []
    for x in (a - a.mean(), b - b.mean()):
        ss = x @ x
        rho.append([float(x[k:] @ x[:-k] / ss) if ss else 0.0 for k in range(1, bartlett_lags(n) + 1)])
    down = 1 + 2 * sum((1 - k / n) * x * y for k, (x, y) in enumerate(zip(*rho, strict=True), 1))
    return float(n) if down <= 0 else max(3.0, min(float(n), n / down))


def effective_sample_size(p: np.ndarray, t: np.ndarray, r: float | None) -> Check:
    """Only where the pairs are serially correlated: the correlation's p-value at the effective number."""
    n = len(p)
    lags = min(10, n // 4)
    if lags < 1 or min(kernels.ljung_box(x, lags)[1] for x in (p, t)) >= 0.05:
        return Check("effective_sample_size", PASS, n, 0.05, "no serial correlation to correct for")
    n_eff = effective_n(p, t)
    value = correlation_p(r, n_eff)
    return Check("effective_sample_size", PASS if value is not None and value < 0.05 else WARN, round(n_eff, 1), 0.05, f"{n_eff:.1f} of {n} observations count; p = {value if value is None else round(value, 4)}")


def lag_sensitivity(profile: dict[int, float | None], at: int = 0, most: float = 30.0) -> Check:
    """How much of the correlation goes at the lags beside it; their signed mean is taken first."""
    own = profile.get(at)
    beside = [profile[k] for k in (at - 1, at + 1) if profile.get(k) is not None]
    if own is None or not beside or own == 0:
        return Check("lag_sensitivity", WARN, None, most, "no neighbouring lags")
    drop = round((abs(own) - abs(sum(beside) / len(beside))) / abs(own) * 100, 2)
    return Check("lag_sensitivity", WARN if drop > most else PASS, drop, most, f"{drop} % lost at neighbouring lags")


def outlier_sensitivity(p: np.ndarray, t: np.ndarray, share: float = 0.01, most: float = 30.0) -> Check:
    n = len(p)
    if n < 20:
        return Check("outlier_sensitivity", WARN, None, most, "too few pairs")
    z = [np.abs((x - x.mean()) / x.std()) if x.std() > 0 else np.zeros(n) for x in (p, t)]
    keep = np.sort(np.argsort(-(z[0] + z[1]), kind="stable")[max(1, round(share * n)) :])
    full, rest = kernels.correlation(p, t), kernels.correlation(p[keep], t[keep])
    if np.isnan(full) or np.isnan(rest):
        return Check("outlier_sensitivity", WARN, None, most, "no correlation of a constant")
    drop = round((abs(full) - abs(rest)) / abs(full) * 100, 2) if full else 0.0
    return Check("outlier_sensitivity", WARN if drop > most else PASS, drop, most, f"{drop} % lost without the most extreme pairs")


def one_sided(p: float | None, r: float | None, direction: str | None) -> float | None:
    """Half, or one less half, by whether the sign is the one expected; as it is where none is."""
    if p is None or direction not in ("positive", "negative"):
        return p
    return p / 2 if (r > 0) == (direction == "positive") else 1 - p / 2


def multiple_testing(r: float | None, n: int, tested: int | None, *, pre_specified: bool = False, direction: str | None = None, alpha: float = 0.05) -> Check:
    if not tested:
        return Check("multiple_testing", FAIL, None, alpha, "the number of features tested is not known")
    p = one_sided(correlation_p(r, n), r, direction)
    if p is None or n <= 3:
        return Check("multiple_testing", WARN, None, alpha, "no p-value")
    shown = f"p = {p:.4f}, deflated r = {deflated_correlation(r, n, tested):.4f}, {tested} tested"
    if pre_specified:
        return Check("multiple_testing", PASS if p < alpha else WARN, round(p, 4), alpha, f"pre-specified feature; {shown}")
    return Check("multiple_testing", PASS if p <= alpha / tested else FAIL, round(min(1.0, p * tested), 4), alpha, shown)


def regime_split(p: np.ndarray, t: np.ndarray, at: int | None = None, least: int = 8, most: float = 50.0) -> Check:
    at = len(p) // 2 if at is None else at
    if min(at, len(p) - at) < least:
        return Check("regime_split", WARN, None, most, "too few pairs on a side")
    a, b = kernels.correlation(p[:at], t[:at]), kernels.correlation(p[at:], t[at:])
    if np.isnan(a) or np.isnan(b):
        return Check("regime_split", WARN, None, most, "no correlation of a constant")
    spread = 100.0 if a * b < 0 else round(abs(a - b) / max(abs(a), abs(b), 1e-12) * 100, 2)
    return Check("regime_split", WARN if spread > most else PASS, spread, most, f"r = {a:.3f} before, {b:.3f} after")


def revisions(handled: bool, source: str | None = None) -> list[Check]:
    """Of signals that declare revisions."""
    said = f"first vintages from {source}" if handled else "the target is revised and final values were used"
    return [Check(n, PASS if handled else WARN, handled, None, said) for n in ("revisions", "point_in_time_safety")]


def relationship(profile: dict[int, float | None], *, predictor: np.ndarray | None = None, target: np.ndarray | None = None, survives: bool = True, feature: str | None = None, alpha: float = 0.05) -> tuple[str, str]:
    """What kind of relationship it looks like, and why: the feature's own lag and the profile's best lag make its lead."""
    known = {k: r for k, r in profile.items() if r is not None}
    if not known:
        return "unknown", "there is no lead-lag profile"
    if not survives:
        return "spurious", "the relationship is not there out of sample"
    best = max(known, key=lambda k: (abs(known[k]), -k))
    found = re.search(r"::lag_(\d+)$", feature or "")
    lead = best + (int(found[1]) if found else 0)
    if lead <= 0:
        return ("coincident" if lead == 0 else "lagging"), f"lead {lead} at r = {known[best]:.2f}"
    p = None if predictor is None or target is None else kernels.granger(predictor, target, min(4, max(1, lead + 1)))
    if p is not None and p < alpha:
        return "causal", f"lead {lead}; Granger p = {p:.3f}; subject to the hypothesis's mechanism"
    return "proxy", f"lead {lead}; " + ("no Granger evidence" if p is None else f"Granger p = {p:.3f}")


def profile_of(p: np.ndarray, t: np.ndarray, lags: range = range(7)) -> dict[int, float | None]:
    """Correlations of the predictor some rows before with the target, of three complete pairs or more, to 4 digits."""
    out: dict[int, float | None] = {}
    for k in lags:
        a, b = p[: max(0, len(p) - k)], t[k:]
        whole = ~(np.isnan(a) | np.isnan(b))
        r = kernels.correlation(a[whole], b[whole]) if whole.sum() >= 3 else float("nan")
        out[k] = None if np.isnan(r) else round(r, 4)
    return out


def checks_of(p: np.ndarray, t: np.ndarray, *, features_tested: int | None, pre_specified: bool, feature: str | None, revised: bool, vintage_handled: bool | None, vintage_source: str | None, split: bool, survives: bool) -> tuple[list[Check], tuple[str, str]]:
    """All checks of the test pairs, in order of time with NaN for what is missing, and the kind of relationship. P-values are two-sided here."""
    whole = ~(np.isnan(p) | np.isnan(t))
    a, b, n = p[whole], t[whole], int(whole.sum())
    r = kernels.correlation(a, b) if n >= 3 else None
    r = None if r is None or np.isnan(r) else r
    profile = profile_of(p, t)
    found = [sample_size(n), missingness(len(t), int(np.isnan(t).sum())), outliers(t), stationarity_adf(t), stationarity_kpss(t), autocorrelation(t), effective_sample_size(a, b, r), lag_sensitivity(profile), outlier_sensitivity(a, b), multiple_testing(r, n, features_tested, pre_specified=pre_specified)]
    if revised or vintage_handled is not None:
        found += revisions(bool(vintage_handled), vintage_source)
    if split:
        found.append(regime_split(a, b))
    return found, relationship(profile, predictor=a, target=b, survives=survives, feature=feature)


def gate(checks: list[Check], search: dict, *, survives_oos: bool, walk_forward: bool) -> dict:
    """The lowest tier of all checks, of the search, of out-of-sample survival (medium at best) and of walk-forward (medium where off); the first lowest binds."""
    limits = [(c.name, OF_VERDICT[c.verdict]) for c in checks]
    limits += [("feature_search", search["confidence_cap"]), ("out_of_sample", "medium" if survives_oos else "low")] + ([] if walk_forward else [("walk_forward", "medium")])
    name, cap = min(limits, key=lambda x: TIER[x[1]])
    return {"confidence_cap": cap, "binding_constraint": name}
