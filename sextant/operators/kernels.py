"""What has no relational form, in numpy, for one rolled-up series at a time; each runs as a grouped Arrow function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sextant.functions.special import chi2_tail, f_tail, kpss_p, student_two_sided, unit_root_p


def per_series(df: DataFrame, by: list[str], order: str, kernel: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """``kernel`` of each group's rows in order, as a row; a group is a series after rollup, so it fits a task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(by, key, strict=True)) | kernel(rows.sort_values(order))])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.groupBy(*by).applyInPandas(run, f"{fields}, {schema}")


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, residuals, sum of squared residuals."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, e, float(e @ e)


def inverse(m: np.ndarray) -> np.ndarray:
    """The inverse of a matrix of products, of columns of whatever scale; generalised where columns depend on each other."""
    d = np.sqrt(np.clip(np.diag(m), 0, None))
    d = np.where(d > 0, d, 1)
    return np.linalg.pinv(m / np.outer(d, d)) / np.outer(d, d)


def adf_fit(v: np.ndarray, lags: int, rows: int, constant: bool) -> tuple[float, float]:
    """The t value of the level and the information criterion, over the last ``rows`` rows."""
    d = np.diff(v)
    x = np.column_stack([v[:-1][-rows:], *(d[len(d) - rows - k : len(d) - k] for k in range(1, lags + 1)), *([np.ones(rows)] if constant else [])])
    y = d[-rows:]
    b, _, ss = ols(x, y)
    cov = inverse(x.T @ x) * ss / max(1, rows - x.shape[1])
    likelihood = -rows / 2 * (np.log(2 * np.pi) + np.log(max(ss, 1e-300) / rows) + 1)
    return float(b[0] / np.sqrt(max(cov[0, 0], 1e-300))), -2 * likelihood + 2 * x.shape[1]


def adf(values: np.ndarray, constant: bool = True, series: int = 1) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller: statistic, p-value, lags. Of up to 12 (n/100)^(1/4) lags, those with the least AIC on a common sample."""
    v = np.asarray(values, float)
    n = len(v)
    most = max(0, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - constant - 1))
    best = min(range(most + 1), key=lambda k: adf_fit(v, k, n - 1 - most, constant)[1])
    t, _ = adf_fit(v, best, n - 1 - best, constant)
    return t, unit_root_p(t, series), best


def kpss(values: np.ndarray) -> tuple[float, float, int]:
    """Level stationarity: statistic, p-value, lags by the automatic bandwidth of Hobijn, Franses and Ooms."""
    e = np.asarray(values, float) - np.mean(values)
    n = len(e)
    cut = int(n ** (2 / 9))
    s0 = e @ e / n
    s1 = 0.0
    for k in range(1, cut + 1):
        g = e[k:] @ e[:-k] / (n / 2)
        s0, s1 = s0 + g, s1 + k * g
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0
    long_run = e @ e / n + 2 / n * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / long_run) if long_run > 0 else 0.0
    return stat, kpss_p(stat), lags


def ljung_box(values: np.ndarray, lags: int) -> tuple[float, float]:
    x = np.asarray(values, float) - np.mean(values)
    n, ss = len(x), x @ x
    q = n * (n + 2) * sum((x[k:] @ x[:-k] / ss) ** 2 / (n - k) for k in range(1, lags + 1)) if ss else 0.0
    return float(q), chi2_tail(q, lags)


def granger_f(predictor: np.ndarray, target: np.ndarray, k: int) -> tuple[float, int] | None:
    """F of the predictor's last ``k`` values beside the target's own, and its degrees of freedom; none without any."""
    y = target[k:]
    own = [target[k - i : len(target) - i] for i in range(1, k + 1)]
    other = [predictor[k - i : len(predictor) - i] for i in range(1, k + 1)]
    small = np.column_stack([np.ones(len(y)), *own])
    full = np.column_stack([small, *other])
    df = len(y) - full.shape[1]
    if df <= 0:
        return None
    a, b = ols(small, y)[2], ols(full, y)[2]
    return (a - b) / k / max(b / df, 1e-300), df


def granger(predictor: np.ndarray, target: np.ndarray, most: int = 4) -> float | None:
    """The least p-value over lags 1 to ``most`` of an F test that the predictor's lags add nothing; none for a short series."""
    if len(target) < most + 10:
        return None
    found = [(k, granger_f(predictor, target, k)) for k in range(1, most + 1)]
    return min((f_tail(x[0], k, x[1]) for k, x in found if x), default=None)


def block_bootstrap(x: np.ndarray, y: np.ndarray, stat: Callable, block: int = 12, reps: int = 2000, seed: int = 12345) -> tuple[float, float]:
    """A 95 % interval by moving blocks; unknown for fewer than two blocks."""
    n = len(x)
    if n < 2 * block:
        return float("nan"), float("nan")
    r, count = np.random.default_rng(seed), -(-n // block)
    got = np.empty(reps)
    for k in range(reps):
        at = (r.integers(0, n - block + 1, size=count)[:, None] + np.arange(block)).ravel()[:n]
        got[k] = stat(x[at], y[at])
    low, high = np.nanpercentile(got, [2.5, 97.5])
    return float(low), float(high)


def case_bootstrap(x: np.ndarray, y: np.ndarray, which: int, reps: int = 2000, seed: int = 20260621) -> tuple[float, float]:
    """A 95 % interval of one coefficient by resampled rows."""
    r, n = np.random.default_rng(seed), len(y)
    got = []
    for _ in range(reps):
        at = r.integers(0, n, n)
        got.append(ols(x[at], y[at])[0][which])
    low, high = np.percentile(got, [2.5, 97.5])
    return float(low), float(high)


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    d = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / d) if d else float("nan")


def ols_hac(x: np.ndarray, y: np.ndarray, lags: int = 12) -> dict:
    """Least squares with a constant, and Newey and West's errors with Bartlett weights: coefficients, t, p, 95 % intervals, R2, F."""
    x = np.column_stack([np.ones(len(y)), x])
    b, e, ss = ols(x, y)
    u = x * e[:, None]
    meat = u.T @ u
    for k in range(1, min(lags, len(y) - 1) + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    bread = inverse(x.T @ x)
    cov = bread @ meat @ bread
    se = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
    t, df = b / se, len(y) - x.shape[1]
    r2 = 1 - ss / max(1e-300, ((y - y.mean()) ** 2).sum())
    k = x.shape[1] - 1
    f = float(b[1:] @ inverse(cov[1:, 1:]) @ b[1:] / k) if k else 0.0
    return {"coef": b.tolist(), "t": t.tolist(), "p": [student_two_sided(v, df) for v in t], "ci_low": (b - 1.96 * se).tolist(), "ci_high": (b + 1.96 * se).tolist(), "r2": float(r2), "f": f, "f_p": f_tail(f, k, df) if k else 1.0}


def pca(n: float, sums: np.ndarray, products: np.ndarray, components: int = 5) -> dict:
    """Principal components of standardised columns, from n, sums and sums of products; each loading's largest entry is positive."""
    cov = products / n - np.outer(sums / n, sums / n)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    ok = np.where(sd > 0, sd, 1)
    value, vector = np.linalg.eigh(cov / np.outer(ok, ok))
    order = np.argsort(-value)[: min(components, len(value))]
    v = vector[:, order] * np.sign(vector[np.abs(vector[:, order]).argmax(0), order])
    return {"eigenvalues": (value[order] * n / (n - 1)).tolist(), "ratios": (value[order] / value.sum()).tolist(), "loadings": v.T.tolist()}


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, degree: int = 1, ahead: int = 0) -> np.ndarray:
    """Local regression on the index, tricube weights over ``span`` neighbours; from ``ahead`` before to ``ahead`` after the series."""
    n = len(y)
    weights = np.ones(n) if weights is None else weights
    out = np.empty(n + 2 * ahead)
    x = np.arange(n)
    for k, at in enumerate(range(-ahead, n + ahead)):
        q = min(span, n)
        a = int(np.clip(at - q // 2, 0, n - q))
        d = np.abs(x[a : a + q] - at)
        reach = max(d.max(), 1) * (1 if span <= n else span / n) + 1e-9
        w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3 * weights[a : a + q]
        s = w.sum()
        if s <= 0:
            out[k] = y[a : a + q].mean()
            continue
        m = (w * x[a : a + q]).sum() / s
        spread = (w * (x[a : a + q] - m) ** 2).sum()
        mean = (w * y[a : a + q]).sum() / s
        slope = (w * (x[a : a + q] - m) * y[a : a + q]).sum() / spread if degree and spread > 1e-12 else 0.0
        out[k] = mean + slope * (at - m)
    return out


def stl(values: np.ndarray, period: int, robust: bool = True, seasonal: int = 7) -> dict[str, np.ndarray]:
    """Cleveland and others' decomposition into trend, seasonal and remainder by repeated local regression."""
    y = np.asarray(values, float)
    n = len(y)
    odd = lambda k: int(k) + (int(k) + 1) % 2
    long, low = odd(np.ceil(1.5 * period / (1 - 1.5 / seasonal))), odd(period)
    trend, season, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range(3 if robust else 1):
        for _ in range(2):
            free = y - trend
            cycle = np.empty(n + 2 * period)
            for s in range(period):
                cycle[s::period] = loess(free[s::period], seasonal, rho[s::period], ahead=1)[: len(cycle[s::period])]
            smooth = cycle
            for k in (period, period, 3):
                smooth = np.convolve(smooth, np.ones(k) / k, "valid")
            season = cycle[period : period + n] - loess(smooth, low)[:n]
            trend = loess(y - season, long, rho)
        rest = y - trend - season
        h = 6 * np.median(np.abs(rest))
        rho = np.clip(1 - (np.abs(rest) / h) ** 2, 0, 1) ** 2 if robust and h > 0 else rho
    return {"trend": trend, "seasonal": season, "resid": y - trend - season}


def strength(parts: dict[str, np.ndarray]) -> dict[str, float]:
    """How much of the variance the trend and the season take from the remainder, and Durbin and Watson's statistic."""
    e = parts["resid"]
    of = lambda k: max(0.0, 1 - float(np.var(e)) / max(1e-300, float(np.var(parts[k] + e))))
    return {"trend_strength": of("trend"), "seasonal_strength": of("seasonal"), "durbin_watson": float((np.diff(e) ** 2).sum() / max(1e-300, (e**2).sum()))}


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Unit root of the residuals of one series on the other: statistic and p-value."""
    _, e, _ = ols(np.column_stack([b, np.ones(len(b))]), a)
    return adf(e, constant=False, series=2)[:2]


# 95 % critical values of Johansen's trace statistic with a constant, by series less rank.
TRACE_95 = {1: 3.8415, 2: 15.4943, 3: 29.7961, 4: 47.8545, 5: 69.8189, 6: 95.7542}


def johansen(series: np.ndarray, lags: int = 1) -> list[dict]:
    """Trace statistics for ranks 0 up, with a constant and ``lags`` lagged differences."""
    x = np.asarray(series, float)
    d = np.diff(x, axis=0)
    z = np.column_stack([d[lags - k : len(d) - k] for k in range(1, lags + 1)]) if lags else np.zeros((len(d), 0))
    left, level = d[lags:], x[lags:-1]
    z = np.column_stack([z, np.ones(len(left))])
    clean = lambda m: m - z @ np.linalg.lstsq(z, m, rcond=None)[0]
    r0, r1 = clean(left), clean(level)
    n, k = r0.shape
    s00, s11, s01 = r0.T @ r0 / n, r1.T @ r1 / n, r0.T @ r1 / n
    eig = np.sort(np.real(np.linalg.eigvals(np.linalg.pinv(s11) @ s01.T @ np.linalg.pinv(s00) @ s01)))[::-1]
    eig = np.clip(eig, 0, 1 - 1e-12)
    return [{"rank": r, "trace": float(-n * np.log(1 - eig[r:]).sum()), "critical_95": TRACE_95.get(k - r)} for r in range(k)]


def stationarity(values: np.ndarray) -> dict:
    """Both tests and what they say together."""
    v = values[~np.isnan(values)]
    a, pa, _ = adf(v)
    k, pk, _ = kpss(v)
    verdict = {(True, True): "stationary", (False, False): "non-stationary", (True, False): "difference-stationary", (False, True): "trend-stationary"}[pa < 0.05, pk >= 0.05]
    return {"adf": a, "adf_p": pa, "kpss": k, "kpss_p": pk, "verdict": verdict}
