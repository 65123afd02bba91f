"""Special functions: Column expressions for the normal distribution and log-gamma, numpy kernels for the gamma family."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.expr import let

# Coefficients of the rational approximation of the normal quantile by P. J. Acklam.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
# Terms of the Lanczos sum with g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _horner(terms: tuple[float, ...], x):
    out = terms[0]
    for c in terms[1:]:
        out = out * x + c
    return out


def normal_ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution, relative error under 1.2e-9; null outside (0, 1)."""
    q = p - 0.5
    middle = q * _horner(_A, q * q) / _horner(_B, q * q)
    low = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(_C, low) / _horner(_D, low)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(middle)


# Rational approximation of the upper tail by J. F. Hart, as given by G. West.
_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_M = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal distribution."""
    x = F.abs(z)
    near = F.exp(-x * x / 2) * _horner(_N, x) / _horner(_M, x)
    far = F.exp(-x * x / 2) / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / 2.506628274631
    upper = F.when(x > 37, 0.0).when(x < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    """:func:`normal_cdf` over an array."""
    x = np.abs(z)
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.exp(-x * x / 2) * _horner(_N, x) / _horner(_M, x)
        far = np.exp(-x * x / 2) / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / 2.506628274631
    upper = np.where(x > 37, 0.0, np.where(x < 7.07106781186547, near, far))
    return np.where(z > 0, 1 - upper, upper)


def normal_ppf_array(p: np.ndarray) -> np.ndarray:
    """:func:`normal_ppf` over an array of probabilities inside (0, 1)."""
    q, low = p - 0.5, np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    middle = q * _horner(_A, q * q) / _horner(_B, q * q)
    tail = _horner(_C, low) / _horner(_D, low)
    return np.where(p < 0.02425, tail, np.where(p > 1 - 0.02425, -tail, middle))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive arguments."""
    y, t = x - 1, x + 6.5
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (y + i)
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


#: Shapes above which the gamma distribution is taken by its cube root, which is nearly normal; terms per root of the shape below.
LARGE_SHAPE, TERMS, TERMS_OF_ROOT = 1e5, 60, 12


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function P(a, x) for a > 0: null for null or NaN arguments, 0 for x <= 0.

    Below a + 1 the power series, above it the continued fraction, both from the last term back to the first as a fold
    over as many numbers as the shape needs, so a row costs about 60 + 12 sqrt(a) steps; no Python worker is involved.
    Beyond ``LARGE_SHAPE`` the cube root is taken as normal, which is right to about 1e-8.
    """
    known = a.isNotNull() & x.isNotNull() & ~F.isnan(a) & ~F.isnan(x)

    def value(v: Column) -> Column:
        a, x = v["a"], v["x"]
        back = F.sequence(F.ceil(TERMS + TERMS_OF_ROOT * F.sqrt(F.least(a, F.lit(LARGE_SHAPE)))).cast("int"), F.lit(1))
        front = F.exp(a * F.log(x) - x - v["l"])
        series = front / a * F.aggregate(back, F.lit(1.0), lambda s, k: 1 + s * x / (a + k))
        fraction = front / F.aggregate(back, x + 2 * F.size(back) + 1 - a, lambda t, k: x + 2 * k - 1 - a - k * (k - a) / t)
        cube = let(3 * F.sqrt(a) * (F.pow(x / a, F.lit(1 / 3)) - 1 + 1 / (9 * a)), normal_cdf)
        inside = F.when(a > LARGE_SHAPE, cube).when(x < a + 1, series).when(x > a + 2000 + 100 * F.sqrt(a), F.lit(1.0)).otherwise(1 - fraction)
        return F.when(x <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))

    return F.when(known & (a > 0), let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x"), log_gamma(a.cast("double")).alias("l")), value))


def gamma_p_inverse(a: Column, p: Column, steps: int = 40) -> Column:
    """The x at which P(a, x) = p, for 0 < p < 1; null elsewhere. Newton steps for the logarithm of x, none longer than one."""

    def value(v: Column) -> Column:
        a, p = v["a"], v["p"]
        cube = F.pow(F.greatest(F.lit(1e-3), 1 - 1 / (9 * a) + v["z"] / (3 * F.sqrt(a))), F.lit(3.0))
        start = F.when(a > 1, F.log(a * cube)).otherwise(F.least((F.log(p) + v["l"] + F.log(a)) / a, F.lit(2.0)))

        def step(u: Column, _: Column) -> Column:
            slope = F.exp(a * u - F.exp(u) - v["l"])
            return u - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (gamma_p(a, F.exp(u)) - p) / F.greatest(slope, F.lit(1e-300))))

        return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))

    given = F.struct(a.cast("double").alias("a"), p.cast("double").alias("p"), normal_ppf(p.cast("double")).alias("z"), log_gamma(a.cast("double")).alias("l"))
    return F.when((a > 0) & (p > 0) & (p < 1), let(given, value))


def gamma_cdf(a: np.ndarray | float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function for one shape and many values: series below a + 1, continued fraction above."""
    x = np.asarray(x, float)
    if a > LARGE_SHAPE:
        return np.where(x > 0, normal_cdf_array(3 * math.sqrt(a) * (np.cbrt(np.maximum(x, 0) / a) - 1 + 1 / (9 * a))), 0.0)
    out = np.zeros_like(x)
    low = (x > 0) & (x < a + 1)
    if low.any():
        v = x[low]
        term = total = np.full_like(v, 1 / a)
        for n in range(1, 2000):
            term = term * v / (a + n)
            total = total + term
            if (term < total * 1e-16).all():
                break
        out[low] = total * np.exp(-v + a * np.log(v) - math.lgamma(a))
    high = x >= a + 1
    if high.any():
        v = x[high]
        b = v + 1 - a
        c, d = np.full_like(v, 1e300), 1 / b
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - np.exp(-v + a * np.log(v) - math.lgamma(a)) * h
    return np.clip(out, 0, 1)


def gamma_ppf(a: float, p: np.ndarray) -> np.ndarray:
    """Inverse of :func:`gamma_cdf` by bisection."""
    lo, hi = np.zeros_like(p), np.full_like(p, a + 40 * math.sqrt(a) + 60)
    for _ in range(120):
        mid = (lo + hi) / 2
        below = gamma_cdf(a, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2
