"""Tail probabilities.

The normal and Kolmogorov laws are plain column expressions, so they stay in
the JVM and may run on any number of rows. Student, Fisher and chi-square tails
are Arrow-batched pandas UDFs and run on *reduced* rows only (one per test).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Rational approximations of erfc (W. J. Cody, 1969), three ranges.
_ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2,
            3.77485237685302021e2, 3.20937758913846947e3]
_ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2,
            1.28261652607737228e3, 2.84423683343917062e3]
_MID_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594,
            6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
            1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
_MID_DEN = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
            1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
            3.43936767414372164e3, 1.23033935480374942e3]
_FAR_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
            1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
_FAR_DEN = [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1,
            6.05183413124413191e-2, 2.33520497626869185e-3]


def _horner(x: str, coefficients: list[float]) -> str:
    """Polynomial in SQL, highest power first."""
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}D)", coefficients[1:], f"{coefficients[0]!r}D")


def _erfc(x: str) -> str:
    """Complementary error function of a column or lambda variable, in SQL."""
    y, sq = f"abs({x})", f"({x} * {x})"
    near = f"1 - {y} * {_horner(sq, _ERF_NUM)} / {_horner(sq, _ERF_DEN)}"
    mid = f"exp(-{sq}) * {_horner(y, _MID_NUM)} / {_horner(y, _MID_DEN)}"
    inv = f"(1D / {sq})"
    far = f"exp(-{sq}) / {y} * ({1.0 / math.sqrt(math.pi)!r}D - {inv} * {_horner(inv, _FAR_NUM)} / {_horner(inv, _FAR_DEN)})"
    upper = f"CASE WHEN {y} <= 0.46875D THEN {near} WHEN {y} <= 4D THEN {mid} ELSE {far} END"
    return f"CASE WHEN {x} < 0 THEN 2 - ({upper}) ELSE {upper} END"


def normal_cdf_of(column: str) -> Column:
    """Normal distribution function of a named column, in generated code for bulk rows."""
    return F.expr(f"0.5D * ({_erfc(f'(`{column}` * {-1.0 / math.sqrt(2.0)!r}D)')})")


def normal_two_sided(column: str) -> Column:
    """Two-sided normal p-value of a named z column (computed once per row)."""
    z = f"abs(`{column}`) * {1.0 / math.sqrt(2.0)!r}D"
    return F.expr(f"get(transform(array({z}), v -> least(1D, {_erfc('v')})), 0)")


def kolmogorov_sf(column: str) -> Column:
    """2·Σ(−1)^(k−1)·exp(−2k²λ²) of a named λ column; below 0.2 the value is 1 to 12 digits."""
    lam = f"`{column}`"
    total = f"aggregate(sequence(1, 20), 0D, (s, k) -> s + (CASE WHEN k % 2 = 1 THEN 2D ELSE -2D END) * exp(-2D * k * k * {lam} * {lam}))"
    return F.expr(f"CASE WHEN {lam} < 0.2D THEN 1D WHEN {lam} IS NOT NULL THEN greatest(0D, least(1D, {total})) END")


# -- incomplete beta and gamma: small scalar helpers for reduced rows ------

_TINY = 1e-300


def _fraction(step, first: float) -> float:
    """Modified Lentz evaluation of a continued fraction from its (a, b) pairs."""
    value = first or _TINY
    c, d = value, 0.0
    for i in range(1, 100_000):
        a, b = step(i)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if not x > 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i == 1:
            return 1.0, 1.0
        j = i - 1
        m = j // 2
        if j % 2 == 0:
            return m * (b - m) * x / ((a + j - 1.0) * (a + j)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + j - 1.0) * (a + j)), 1.0

    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    return min(1.0, math.exp(log_front) / a * _fraction(step, 0.0))


#: From here on the uniform expansion is used: its error falls as s^(-3/2), series grow as s^(1/2).
LARGE_SHAPE = 1e5


def _gamma_sf_large(s: float, x: float) -> float:
    """Q(s, x) by the leading terms of the uniform asymptotic expansion in 1/s."""
    m = (x - s) / s
    # m - ln(1 + m), without cancellation near 0.
    gap = m * m * (0.5 - m * (1 / 3 - m * (0.25 - m * 0.2))) if abs(m) < 1e-3 else m - math.log1p(m)
    eta = math.copysign(math.sqrt(2.0 * gap), m)
    near = -1 / 3 + eta / 12 if abs(eta) < 1e-3 else 1 / m - 1 / eta
    rest = math.exp(-0.5 * s * eta * eta) / math.sqrt(2 * math.pi * s) * near
    return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(s / 2.0)) + rest))


def gamma_sf(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x)."""
    if not x > 0.0:
        return 1.0
    if s >= LARGE_SHAPE:
        return _gamma_sf_large(s, x)
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)

    def step(i: int) -> tuple[float, float]:
        if i == 1:
            return 1.0, x + 1.0 - s
        j = i - 1
        return -j * (j - s), x + 2.0 * j + 1.0 - s

    return front * _fraction(step, 0.0)


def student_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def fisher_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def student_quantile(p: float, df: float) -> float:
    """t with P(|T| ≤ t) = p: Newton steps from the expansion around the normal quantile."""
    z = float(normal_quantile(np.array([0.5 + p / 2.0]))[0])
    t = z + (z**3 + z) / (4.0 * df) if df > 2 else z
    front = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    for _ in range(100):
        density = math.exp(front - (df + 1) / 2 * math.log1p(t * t / df))
        step = (student_two_sided(t, df) - (1.0 - p)) / (2.0 * density)
        t = max(t / 2.0, t + step)
        if abs(step) < 1e-13 * max(1.0, t):
            break
    return t


def vectorized(fn, first, *degrees) -> np.ndarray:
    """fn over rows; NaN where an input is NaN or a degree of freedom is not positive."""
    rows = zip(*[np.asarray(a, dtype=float) for a in (first, *degrees)])
    return np.array([
        math.nan if any(math.isnan(v) for v in row) or not all(d > 0 for d in row[1:])
        else 0.0 if math.isinf(row[0]) else fn(*row) for row in rows
    ], dtype=float)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student p-value."""
    return pd.Series(vectorized(student_two_sided, t, df))


@F.pandas_udf(T.DoubleType())
def fisher_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail F p-value."""
    return pd.Series(vectorized(fisher_upper, f, d1, d2))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper-tail chi-square p-value."""
    return pd.Series(vectorized(lambda v, k: gamma_sf(k / 2.0, v / 2.0), x, df))


# Normal quantile, algorithm AS 241 (Wichura, 1988), lowest power first.
_Q_NEAR = ([3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3,
            1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
            3.3430575583588128105e4, 2.5090809287301226727e3],
           [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
            5.2264952788528545610e3])
_Q_MID = ([1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
           3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1,
           2.27238449892691845833e-2, 7.74545014278341407640e-4],
          [1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
           1.05075007164441684324e-9])
_Q_FAR = ([6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7],
          [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
           2.04426310338993978564e-15])


def normal_quantile(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))

    def ratio(pair, v):
        return np.polyval(pair[0][::-1], v) / np.polyval(pair[1][::-1], v)

    near = q * ratio(_Q_NEAR, 0.180625 - q * q)
    outer = np.where(r <= 5.0, ratio(_Q_MID, r - 1.6), ratio(_Q_FAR, r - 5.0))
    return np.where(np.abs(q) <= 0.425, near, np.sign(q) * outer)
