"""Maximum-likelihood fits of five families to each cell's record, one cell to a task's call."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.config import AIC_SWITCH_THRESHOLD
from panelweave.functions.expr import let
from panelweave.functions.special import gamma_cdf, gamma_p, gamma_p_inverse, gamma_ppf, normal_cdf, normal_cdf_array, normal_ppf, normal_ppf_array
from panelweave.operators.standardize import clipped_index

#: Positive values and values that a record needs.
MIN_POSITIVE, MIN_VALUES = 6, 10


def _minimum(f, start: list[float], step: float = 0.2, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Nelder-Mead descent in one to three dimensions."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + step * np.eye(n)[k] for k in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) < 1e-10 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        for scale in (1.0, 2.0, 0.5, -0.5):
            trial = centre + scale * (centre - points[-1])
            v = f(trial)
            if scale == 1.0:
                mirrored, v_mirrored = trial, v
                if values[0] <= v < values[-2]:
                    break
                if v >= values[0]:
                    continue
            elif scale == 2.0:
                if v_mirrored < values[0]:
                    if v > v_mirrored:
                        trial, v = mirrored, v_mirrored
                    break
            elif v < min(v_mirrored, values[-1]):
                break
        else:
            points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
            values = [values[0]] + [f(p) for p in points[1:]]
            continue
        points[-1], values[-1] = trial, v
    best = int(np.argmin(values))
    return points[best], values[best]


def _gamma_ll(x, lx, a, b):
    return float(np.sum((a - 1) * lx - x / b) - len(x) * (math.lgamma(a) + a * math.log(b)))


def fit_gamma(x: np.ndarray) -> tuple[list[float], float]:
    lx = np.log(x)
    a0 = max(math.log(x.mean()) - lx.mean(), 1e-10)
    a = (1 + math.sqrt(1 + 4 * a0 / 3)) / (4 * a0)
    b = x.mean() / a
    return [a, b], _gamma_ll(x, lx, a, b)


def fit_lognormal(x: np.ndarray) -> tuple[list[float], float]:
    lx = np.log(x)
    m, s = lx.mean(), lx.std(ddof=1)
    return [m, s], float(np.sum(-lx - np.log(s) - 0.5 * math.log(2 * math.pi) - (lx - m) ** 2 / (2 * s * s)))


def fit_weibull(x: np.ndarray) -> tuple[list[float], float]:
    """Shape by Newton steps on its likelihood equation, scale in closed form."""
    lx, c = np.log(x), 1.2 / max(np.log(x).std(), 1e-6)
    top = lx.max()
    for _ in range(100):
        w = np.exp(c * (lx - top))
        s0, s1, s2 = w.sum(), (w * lx).sum(), (w * lx * lx).sum()
        g, dg = s1 / s0 - 1 / c - lx.mean(), s2 / s0 - (s1 / s0) ** 2 + 1 / (c * c)
        step = g / dg
        c = c / 2 if c - step <= 0 else c - step
        if abs(step) < 1e-12 * c:
            break
    scale = math.exp(top + math.log(np.exp(c * (lx - top)).mean()) / c)
    return [c, scale], float(np.sum(math.log(c / scale) + (c - 1) * (lx - math.log(scale)) - (x / scale) ** c))


def fit_pearson3(x: np.ndarray) -> tuple[list[float], float]:
    """Skew and scale, with the location of the mean held just under the least value, not below zero."""
    loc = max(0.0, x.min() - 0.001)

    def negative(p):
        skew, scale = p[0], math.exp(p[1])
        if abs(skew) < 1e-4 or abs(skew) > 50:
            return math.inf
        beta, alpha = 2 / (skew * scale), 4 / (skew * skew)
        y = beta * (x - (loc - alpha / beta))
        if (y <= 0).any():
            return math.inf
        return -float(np.sum(math.log(abs(beta)) + (alpha - 1) * np.log(y) - y) - len(x) * math.lgamma(alpha))

    p, v = _minimum(negative, [1.0, math.log(2 * x.std() + 1e-9)])
    return [p[0], loc, math.exp(p[1])], -v


def fit_gengamma(x: np.ndarray) -> tuple[list[float], float]:
    """Shape, power and scale, starting from the gamma fit."""
    lx = np.log(x)

    def negative(p):
        if max(abs(v) for v in p) > 25:
            return math.inf
        a, c, s = math.exp(p[0]), math.exp(p[1]), math.exp(p[2])
        z = c * (lx - p[2])
        if z.max() > 700:
            return math.inf
        return -float(np.sum(math.log(c) - p[2] + (a * c - 1) * (lx - p[2]) - np.exp(z)) - len(x) * math.lgamma(a)) if s > 0 else math.inf

    (a, b), _ = fit_gamma(x)
    p, v = _minimum(negative, [math.log(a), 0.0, math.log(b)])
    return [math.exp(p[0]), math.exp(p[1]), math.exp(p[2])], -v


FITS = [fit_gamma, fit_lognormal, fit_pearson3, fit_weibull, fit_gengamma]


def cdf(family: int, p: list[float], x: np.ndarray) -> np.ndarray:
    if family == 0:
        return gamma_cdf(p[0], x / p[1])
    if family == 1:
        return normal_cdf_array((np.log(x) - p[0]) / p[1])
    if family == 2:
        beta, alpha = 2 / (p[0] * p[2]), 4 / (p[0] * p[0])
        low = gamma_cdf(alpha, beta * (x - (p[1] - alpha / beta)))
        return low if p[0] > 0 else 1 - low
    if family == 3:
        return 1 - np.exp(-((x / p[1]) ** p[0]))
    return gamma_cdf(p[0], (x / p[2]) ** p[1])


def ppf(family: int, p: list[float], q: np.ndarray) -> np.ndarray:
    if family == 0:
        return p[1] * gamma_ppf(p[0], q)
    if family == 1:
        return np.exp(p[0] + p[1] * normal_ppf_array(q))
    if family == 2:
        beta, alpha = 2 / (p[0] * p[2]), 4 / (p[0] * p[0])
        return p[1] - alpha / beta + gamma_ppf(alpha, q if p[0] > 0 else 1 - q) / beta
    if family == 3:
        return p[1] * (-np.log1p(-q)) ** (1 / p[0])
    return p[2] * gamma_ppf(p[0], q) ** (1 / p[1])


#: Plotting positions (rank - 0.3175) / (n + 0.365), and the ends to which probabilities are clipped.
POSITION, BEYOND, CLIP_QUANTILE, CLIP_DISTANCE = 0.3175, 0.365, 1e-8, 1e-12


def goodness(family: int, p: list[float], x: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """Correlation with theoretical quantiles, one-sided Kolmogorov distance, Anderson-Darling statistic; None where one is not finite.

    A record of one value alone has no correlation.
    """
    x, n = np.sort(x), len(x)
    i = np.arange(1, n + 1)
    f = np.clip(cdf(family, p, x), CLIP_DISTANCE, 1 - CLIP_DISTANCE)
    q = ppf(family, p, np.clip((i - POSITION) / (n + BEYOND), CLIP_QUANTILE, 1 - CLIP_QUANTILE))
    ppcc = np.corrcoef(x, q)[0, 1] if np.isfinite(q).all() and x[0] < x[-1] else math.nan
    found = (ppcc, np.abs(f - i / n).max(), -n - np.mean((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))))
    return tuple(float(v) if math.isfinite(v) else None for v in found)


def _fit(family: int, x: np.ndarray) -> tuple[list[float], float]:
    try:
        p, ll = FITS[family](x)
        return (p, ll) if math.isfinite(ll) else ([], -math.inf)
    except (ValueError, OverflowError, ZeroDivisionError, FloatingPointError):
        return [], -math.inf


def fit_cells(acc: DataFrame, switch: float = AIC_SWITCH_THRESHOLD) -> DataFrame:
    """(node_id, dist_id, params, zero_fraction, aics, ppcc, ks_d_upper, ad_a2) of each node's record (node_id, t, acc).

    Gamma stays unless another family's AIC is lower by more than ``switch``. Records with under 10 values or 6
    positive ones, and those without a finite likelihood, get family -1 and nulls. One record is one group: as long as
    the time axis.
    """
    schema = "node_id long, dist_id int, params array<double>, zero_fraction double, aics array<double>, ppcc double, ks_d_upper double, ad_a2 double"

    names = [c.split()[0] for c in schema.split(", ")]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        node, values = int(part.node_id.iloc[0]), part.acc.dropna().to_numpy(float)
        x = values[values > 0]
        none = pd.DataFrame([(node, -1, *[None] * 6)], columns=names)
        if len(values) < MIN_VALUES or len(x) < MIN_POSITIVE:
            return none
        with np.errstate(all="ignore"):
            found = [_fit(k, x) for k in range(5)]
            aics = [2 * (3 if k in (2, 4) else 2) - 2 * ll for k, (_, ll) in enumerate(found)]
            if not any(map(math.isfinite, aics)):
                return none
            best = int(np.argmin(aics))
            best = 0 if math.isfinite(aics[0]) and aics[0] - aics[best] <= switch else best
            try:
                ppcc, ks, ad = goodness(best, found[best][0], x)
            except (ValueError, OverflowError, ZeroDivisionError):
                ppcc, ks, ad = None, None, None
        finite = [a if math.isfinite(a) else None for a in aics]
        return pd.DataFrame([(node, best, [float(v) for v in found[best][0]], float((values == 0).mean()), finite, ppcc, ks, ad)], columns=names)

    return acc.select("node_id", "t", "acc").groupBy("node_id").applyInPandas(fit, schema)


def distribution(family: Column, params: Column, x: Column) -> Column:
    """Distribution function of a fitted family at x > 0, as an expression: null for an unknown family or parameters."""
    a, b, c = (F.get(params, F.lit(k)) for k in range(3))
    alpha, beta = 4 / (a * a), 2 / (a * c)
    lower = gamma_p(alpha, beta * (x - (b - alpha / beta)))
    return (
        F.when(family == 0, gamma_p(a, x / b))
        .when(family == 1, normal_cdf((F.log(x) - a) / b))
        .when(family == 2, F.when(a > 0, lower).otherwise(1 - lower))
        .when(family == 3, 1 - F.exp(-F.pow(x / b, a)))
        .when(family == 4, gamma_p(a, F.pow(x / c, b)))
    )


def quantile(family: Column, params: Column, p: Column) -> Column:
    """The inverse of :func:`distribution` for 0 < p < 1."""
    a, b, c = (F.get(params, F.lit(k)) for k in range(3))
    alpha, beta = 4 / (a * a), 2 / (a * c)
    return (
        F.when(family == 0, b * gamma_p_inverse(a, p))
        .when(family == 1, F.exp(a + b * normal_ppf(p)))
        .when(family == 2, b - alpha / beta + gamma_p_inverse(alpha, F.when(a > 0, p).otherwise(1 - p)) / beta)
        .when(family == 3, b * F.pow(-F.log1p(-p), 1 / a))
        .when(family == 4, c * F.pow(gamma_p_inverse(a, p), 1 / b))
    )


def standardize(acc: DataFrame, fits: DataFrame) -> DataFrame:
    """(node_id, t, spi): the normal quantile of the fitted mix of zeros and a positive family; fits are made once and joined.

    One join by node and one expression: no Python worker, and a cell's record need not come together.
    """
    joined = acc.join(fits.select("node_id", "dist_id", "params", "zero_fraction"), "node_id")
    p = F.when(F.col("acc") > 0, distribution(F.col("dist_id"), F.col("params"), F.col("acc")))
    usable = (F.col("dist_id") >= 0) & F.col("acc").isNotNull() & ~F.isnan("acc")
    index = let(F.struct(p.alias("p"), "zero_fraction", "acc"), lambda v: clipped_index(v["p"], v["zero_fraction"], v["acc"]))
    return joined.select("node_id", "t", F.when(usable, index).alias("spi"))
