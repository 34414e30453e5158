"""Distribution tails that p-values need; scalar, for the driver or a task's own small results."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(a * math.log(x) - x - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * math.exp(a * math.log(x) - x - math.lgamma(a))


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return 1.0 if df <= 0 or not math.isfinite(t) and t != math.inf else beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2) if df > 0 else 1.0


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(min(max(p, 1e-5), 1 - 1e-5))


def ks_tail(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample KS statistic with Stephens' small-sample correction."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    z = (d + 1 / (6 * root)) * (root + 0.12 + 0.11 / root)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * z * z))
    return F.when(z < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
