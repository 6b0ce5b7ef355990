"""The chi-square, F and T-square distributions, for arrays: densities, probabilities, moments.

Incomplete gamma and beta functions by their series and continued fractions,
all elements at once; columns get them through Arrow batches.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from samplewright.workers import on_workers

_lgamma = np.vectorize(lgamma, otypes=[float])
TINY, STEPS = 1e-300, 2000


def gamma_q(a, x) -> np.ndarray:
    """The upper incomplete gamma function over the gamma function; nan outside a > 0, x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    fine = (a > 0) & (x >= 0)
    low, high = fine & (x < a + 1), fine & (x >= a + 1)
    for part, way in ((low, _gamma_series), (high, _gamma_fraction)):
        if part.any():
            out[part] = way(a[part], x[part])
    return out


def _gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = total = 1 / a
    for n in range(1, STEPS):
        term = term * x / (a + n)
        total = total + term
        if (term <= total * 1e-17).all():
            break
    with np.errstate(divide="ignore"):
        return 1 - np.where(x > 0, total * np.exp(-x + a * np.log(x) - _lgamma(a)), 0.0)


def _gamma_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    b = x + 1 - a
    c, d = np.full_like(x, 1 / TINY), 1 / b
    h = d
    for n in range(1, STEPS):
        k = -n * (n - a)
        b = b + 2
        d = k * d + b
        d = 1 / np.where(abs(d) < TINY, TINY, d)
        c = b + k / c
        c = np.where(abs(c) < TINY, TINY, c)
        h = h * d * c
        if (abs(d * c - 1) < 1e-16).all():
            break
    return np.exp(-x + a * np.log(x) - _lgamma(a)) * h


def beta_i(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function; nan outside a, b > 0 and 0 <= x <= 1."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(a.shape, np.nan)
    fine = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[fine & (x == 0)], out[fine & (x == 1)] = 0.0, 1.0
    inner = fine & (x > 0) & (x < 1)
    left = inner & (x < (a + 1) / (a + b + 2))
    for part, flip in ((left, False), (inner & ~left, True)):
        if part.any():
            p, q, y = (b[part], a[part], 1 - x[part]) if flip else (a[part], b[part], x[part])
            front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
            value = front * _beta_fraction(p, q, y)
            out[part] = 1 - value if flip else value
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(abs(d) < TINY, TINY, d)
    h = d
    for m in range(1, STEPS):
        step = 1.0
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(abs(d) < TINY, TINY, d)
            c = 1 + k / c
            c = np.where(abs(c) < TINY, TINY, c)
            step = step * d * c
        h = h * step
        if (abs(d * c - 1) < 1e-16).all():
            break
    return h


def chi2_p_value(x, dof) -> np.ndarray:
    """Probability of a chi-square of x or more."""
    return gamma_q(np.asarray(dof, float) / 2, np.asarray(x, float) / 2)


def f_cdf(x, d1, d2) -> np.ndarray:
    """Probability of an F below x."""
    x, d1, d2 = (np.asarray(v, float) for v in (x, d1, d2))
    return beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def t2_p_value(x, p, n) -> np.ndarray:
    """Probability of a T-square of x or more, p degrees of freedom, n = number of samples - 1; nan unless n - p + 1 > 0."""
    x, p, n = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, p, n)))
    out = np.full(x.shape, np.nan)
    fine = n - p + 1 > 0
    out[fine] = 1 - f_cdf((n - p + 1)[fine] * x[fine] / p[fine] / n[fine], p[fine], (n - p + 1)[fine])
    return out


def chi2_cdf(x, dof) -> np.ndarray:
    """Probability of a chi-square below x."""
    return 1 - chi2_p_value(x, dof)


def _density(of, x, *numbers) -> np.ndarray:
    """exp of a logarithm for x > 0, 0 below; nan where a number isn't positive."""
    x, *numbers = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, *numbers)))
    out = np.where(np.isnan(x), np.nan, 0.0)
    fine = (x > 0) & np.all([n > 0 for n in numbers], axis=0)
    out[fine] = np.exp(of(x[fine], *(n[fine] for n in numbers)))
    out[~np.all([n > 0 for n in numbers], axis=0)] = np.nan
    return out


def chi2_pdf(x, dof) -> np.ndarray:
    """Density of chi-square."""
    return _density(lambda x, k: (k / 2 - 1) * np.log(x) - x / 2 - k / 2 * np.log(2.0) - _lgamma(k / 2), x, dof)


def f_pdf(x, d1, d2) -> np.ndarray:
    """Density of F."""
    log_beta = lambda a, b: _lgamma(a) + _lgamma(b) - _lgamma(a + b)
    return _density(lambda x, a, b: a / 2 * np.log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a * x / b) - log_beta(a / 2, b / 2), x, d1, d2)


def _t2_scale(p, n) -> tuple[np.ndarray, np.ndarray]:
    """What turns T-square into F, and F's second degrees of freedom; nan unless n - p + 1 > 0."""
    p, n = np.broadcast_arrays(np.asarray(p, float), np.asarray(n, float))
    rest = np.where(n - p + 1 > 0, n - p + 1, np.nan)
    with np.errstate(all="ignore"):
        return rest / p / n, rest


def t2_cdf(x, p, n) -> np.ndarray:
    """Probability of a T-square below x."""
    return 1 - t2_p_value(x, p, n)


def t2_pdf(x, p, n) -> np.ndarray:
    """Density of T-square; nan unless n - p + 1 > 0."""
    scale, rest = _t2_scale(p, n)
    return scale * f_pdf(scale * np.asarray(x, float), p, np.where(np.isnan(rest), -1.0, rest))


def t2_range(low, high, p, n) -> np.ndarray:
    """Probability of a T-square from low to high."""
    return t2_cdf(high, p, n) - t2_cdf(low, p, n)


def t2_mean(p, n) -> np.ndarray:
    """Mean of T-square; nan unless n > p + 1."""
    p, n = np.broadcast_arrays(np.asarray(p, float), np.asarray(n, float))
    return np.where(n - p - 1 > 0, n * p / np.where(n - p - 1 > 0, n - p - 1, 1), np.nan)


def t2_variance(p, n) -> np.ndarray:
    """Variance of T-square; nan unless n > p + 3."""
    p, n = np.broadcast_arrays(np.asarray(p, float), np.asarray(n, float))
    fine = n - p - 3 > 0
    return np.where(fine, 2 * n * n * p * (n - 1) / np.where(fine, (n - p - 1) ** 2 * (n - p - 3), 1), np.nan)


def _over_columns(of, *columns: Column) -> Column:
    on_workers(SparkSession.active())

    @F.pandas_udf("double")
    def batch(*series: pd.Series) -> pd.Series:
        return pd.Series(of(*(s.to_numpy(float, na_value=np.nan) for s in series)))

    value = batch(*(c.cast("double") for c in columns))
    return F.when(~F.isnan(value), value)


def chi2_p(x: Column, dof: Column) -> Column:
    """chi2_p_value of columns; null where it has no value."""
    return _over_columns(chi2_p_value, x, dof)


def t2_p(x: Column, p: Column, n: Column) -> Column:
    """t2_p_value of columns; null where it has no value."""
    return _over_columns(t2_p_value, x, p, n)


#: Distributions by name, for columns: see distribution().
OF_COLUMNS = {
    "chi2_pdf": chi2_pdf, "chi2_cdf": chi2_cdf, "chi2_p_value": chi2_p_value, "f_pdf": f_pdf, "f_cdf": f_cdf, "t2_pdf": t2_pdf, "t2_cdf": t2_cdf, "t2_range": t2_range, "t2_p_value": t2_p_value, "t2_mean": t2_mean,
    "t2_variance": t2_variance,
}


def distribution(name: str, *columns: Column) -> Column:
    """A function of OF_COLUMNS of columns; null where it has no value."""
    return _over_columns(OF_COLUMNS[name], *columns)


def zeta_phi(q, twists: tuple[int, int, int] = (0, 0, 0), boost: tuple[float, float, float] = (0.0, 0.0, 0.0), gamma: float = 1.0, largest: int = 5) -> np.ndarray:
    """The phase atan(-gamma q pi^(3/2) / Z00(1; q^2)) of the finite-volume zeta function.

    Z00 is a sum over whole vectors n, each shifted by half the twists and the
    boost's momentum, with its integral term, and a power series in q^2. Of n, the
    first two components lie within `largest` together, the third within the rounded
    root of what they leave of its square.
    """
    q = np.atleast_1d(np.asarray(q, float))
    twist, d = np.array(twists, float), np.array(boost, float)
    unit = d / np.linalg.norm(d) if d.any() else d
    k = np.arange(-largest, largest + 1)
    n = np.stack(np.meshgrid(k, k, k, indexing="ij"), axis=-1).reshape(-1, 3).astype(float)
    rest = largest**2 - n[:, 0] ** 2 - n[:, 1] ** 2
    n = n[(rest >= 0) & (np.abs(n[:, 2]) <= np.floor(np.sqrt(np.maximum(rest, 0)) + 0.5))]
    along = lambda v: (v @ unit)[:, None] * unit
    r = n + d / 2 + twist / 2
    r = r - along(r) + along(r) / gamma
    h = n - along(n) + gamma * along(n)
    r2, h2 = (r * r).sum(axis=1), (h * h).sum(axis=1)
    q2 = q[:, None] ** 2
    with np.errstate(all="ignore"):
        out = (np.exp(q2 - r2) / (r2 - q2)).sum(axis=1)
        # The integrand is smooth and flat at 0: Gauss-Legendre points do.
        x, weight = np.polynomial.legendre.leggauss(200)
        t = (x + 1) / 2
        some = n.any(axis=1)
        sign = np.where((n @ (d + twist)) % 2 == 0, 1.0, -1.0)[some]
        kernel = (np.pi / t) ** 1.5 * np.exp(-(np.pi**2) * h2[some, None] / t)
        out = out + gamma * np.einsum("qt,t,nt,n->q", np.exp(q2 * t), weight / 2, kernel, sign)
    term, power = np.zeros_like(q), np.ones_like(q)
    for m in range(100):
        term = term + power / (m - 0.5)
        power = power * q2[:, 0] / (m + 1)
    return np.arctan(-gamma * q * np.pi**1.5 / ((out + gamma * np.pi**1.5 * term) / np.sqrt(4 * np.pi)))


def phase(q: Column, twists: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """zeta_phi of a column."""
    return _over_columns(lambda x: zeta_phi(x, twists), q)
