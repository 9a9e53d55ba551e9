"""Distribution functions.

``norm_ppf`` is a plain Column expression, because quantile plots call it once per row.
``chi2_sf``, ``f_sf`` and ``t_ppf`` are pandas UDFs; they only ever see one row per column pair.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300

# Coefficients of Wichura's algorithm AS 241 (PPND16) for the normal quantile.
_AS241_A = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
]
_AS241_B = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
]
_AS241_C = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
_AS241_D = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
]
_AS241_E = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
_AS241_F = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
]


def _polynomial(coefficients: list[float], x: Column) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile of ``p`` in (0, 1)."""
    q = p - 0.5
    central_r = F.lit(0.180625) - q * q
    central = q * _polynomial(_AS241_A, central_r) / _polynomial(_AS241_B, central_r)
    tail_r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    near, far = tail_r - 1.6, tail_r - 5.0
    tail = F.when(tail_r <= 5, _polynomial(_AS241_C, near) / _polynomial(_AS241_D, near)).otherwise(
        _polynomial(_AS241_E, far) / _polynomial(_AS241_F, far)
    )
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(F.abs(q) <= 0.425, central)
        .otherwise(F.when(q < 0, -tail).otherwise(tail))
    )


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    b = x + 1 - a
    c = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _stirling_rest(x: float) -> float:
    """lgamma(x) less its leading terms (x - 1/2) log x - x + log(2 pi) / 2, for large x."""
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_beta(a: float, b: float) -> float:
    """log B(a, b), without the cancellation of three large log-gammas when one side is large."""
    a, b = min(a, b), max(a, b)
    if b < 1000:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    total = a + b
    if a < 1000:
        rise = (b - 0.5) * math.log1p(a / b) + a * math.log(total) - a + _stirling_rest(total) - _stirling_rest(b)
        return math.lgamma(a) - rise
    shares = (a - 0.5) * math.log(a / total) + b * math.log1p(-a / total) - 0.5 * math.log(b)
    return shares + 0.5 * math.log(2 * math.pi) + _stirling_rest(a) + _stirling_rest(b) - _stirling_rest(total)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - log_beta(a, b))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    def away(v: float) -> float:
        return v if abs(v) > _TINY else _TINY

    c = 1.0
    d = 1 / away(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / away(1 + even * d)
        c = away(1 + even / c)
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / away(1 + odd * d)
        c = away(1 + odd / c)
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            return h
    raise ArithmeticError(f"incomplete beta did not settle for {a}, {b}, {x}")


def chi2_tail(x: float, dof: float) -> float:
    return upper_gamma(dof / 2, x / 2)


def f_tail(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    # I_x(d2/2, d1/2) = 1 - I_(1-x)(d1/2, d2/2), from the small 1 - x, which does not lose digits for large d2
    a, b, y = d1 / 2, d2 / 2, d1 * f / (d2 + d1 * f)
    front = math.exp(a * math.log(y) - b * math.log1p(d1 * f / d2) - log_beta(a, b))
    if y <= (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(a, b, y) / a
    return front * _beta_fraction(b, a, 1 - y) / b


def t_quantile(p: float, dof: float) -> float:
    """Student t quantile by bisection on the incomplete beta."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    if dof > 1e7:
        return NormalDist().inv_cdf(p)
    lo, hi = 0.0, 1.0
    while 1 - 0.5 * incomplete_beta(dof / 2, 0.5, dof / (dof + hi * hi)) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - 0.5 * incomplete_beta(dof / 2, 0.5, dof / (dof + mid * mid)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _apply(fn, *series: pd.Series) -> pd.Series:
    out = [
        None if any(v is None or v != v for v in values) else fn(*map(float, values))
        for values in zip(*series)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _apply(lambda v, d: chi2_tail(v, d) if d > 0 else 1.0, x, dof)


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _apply(lambda v, a, b: f_tail(v, a, b) if a > 0 and b > 0 else float("nan"), f, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_ppf(p: pd.Series, dof: pd.Series) -> pd.Series:
    return _apply(lambda v, d: t_quantile(v, d) if d > 0 else float("nan"), p, dof)
