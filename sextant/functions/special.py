"""Distribution functions that neither Spark nor the standard library has: tails of normal, Student, F and chi-squared."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, df1: float, df2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def chi2_tail(x: float, df: float) -> float:
    """One less the regularised lower incomplete gamma function: a series below the mean, a continued fraction above."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2
        d = 1 / (top * d + b)
        c = b + top / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


# MacKinnon (1994), p-value surfaces for unit-root tests with a constant, by number of series: where the test's
# range begins, ends, and its knot; coefficients below and above the knot. MacKinnon (2010) for 5 % critical values.
MACKINNON = {
    1: (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-18.86, 0.92, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def unit_root_p(statistic: float, series: int = 1) -> float:
    """The p-value of an augmented Dickey-Fuller (series 1) or Engle-Granger (series 2) statistic, with a constant."""
    low, high, knot, small, large = MACKINNON[series]
    if statistic > high or statistic < low:
        return float(statistic > high)
    return normal_cdf(sum(c * statistic**k for k, c in enumerate(small if statistic <= knot else large)))


# Kwiatkowski et al. (1992), critical values of the level-stationarity statistic.
KPSS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def kpss_p(statistic: float) -> float:
    """By interpolation; 0.10 and 0.01 at the table's ends."""
    if statistic <= KPSS[0][0]:
        return KPSS[0][1]
    for (a, p), (b, q) in zip(KPSS, KPSS[1:], strict=False):
        if statistic <= b:
            return p + (q - p) * (statistic - a) / (b - a)
    return KPSS[-1][1]


def correlation_p(r: float | None, n: float) -> float | None:
    """Two-sided, of a Pearson correlation over n pairs; unknown for n of 2 or less."""
    if r is None or math.isnan(r) or n is None or n <= 2:
        return None
    if abs(r) >= 1:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2) / max(1e-12, 1 - r * r)), n - 2)


def deflated_correlation(r: float | None, n: int, tested: int) -> float | None:
    """The correlation less what the best of ``tested`` noise features would show; at one feature, as it is."""
    if r is None or n <= 3:
        return None
    noise = math.tanh(normal_quantile(1 - 1 / tested) / math.sqrt(n - 3)) if tested > 1 else 0.0
    return math.copysign(max(0.0, abs(r) - noise), r)
