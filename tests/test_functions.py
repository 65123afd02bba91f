import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.functions.graph import connected_components
from panelweave.functions.special import gamma_cdf, gamma_p, gamma_p_inverse, gamma_ppf, log_gamma, normal_cdf, normal_ppf
from panelweave.jobs import catalog
from panelweave.operators import fitting


def test_normal_and_log_gamma_columns(spark):
    z = [-8.0, -3.3, -1.0, 0.0, 0.4, 2.0, 7.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", normal_cdf(F.col("z")).alias("p"), normal_ppf(normal_cdf(F.col("z"))).alias("back")).collect()
    for r in got:
        assert r.p == pytest.approx(NormalDist().cdf(r.z), rel=1e-6, abs=1e-16)
        if abs(r.z) < 6:
            assert r.back == pytest.approx(r.z, abs=1e-6)
    xs = [0.05, 0.5, 1.0, 3.7, 50.0, 1e4]
    for r in spark.createDataFrame([(v,) for v in xs], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-10, abs=1e-12)


def test_gamma_distribution_inverts():
    for a in (0.3, 1.0, 4.5, 60.0):
        p = np.array([0.001, 0.1, 0.5, 0.9, 0.999])
        assert np.allclose(gamma_cdf(a, gamma_ppf(a, p)), p, atol=1e-9)
    assert np.allclose(gamma_cdf(1.0, np.array([0.0, 1.0, 5.0])), 1 - np.exp([0.0, -1.0, -5.0]))


@pytest.mark.parametrize("family", range(5))
def test_fits_are_local_maxima_and_quantiles_invert(family):
    rng = np.random.default_rng(family)
    x = rng.gamma(2.5, 3.0, 800)
    p, ll = fitting.FITS[family](x)
    assert math.isfinite(ll)
    q = np.array([0.05, 0.3, 0.7, 0.95])
    assert np.allclose(fitting.cdf(family, p, fitting.ppf(family, p, q)), q, atol=1e-7)
    if family in (0, 3, 4):
        assert np.abs(np.sort(fitting.cdf(family, p, np.sort(x))) - np.arange(1, 801) / 800).max() < 0.06


def test_weibull_likelihood_is_stationary():
    x = np.random.default_rng(1).weibull(1.7, 500) * 4
    (c, s), ll = fitting.fit_weibull(x)
    at = lambda c, s: float(np.sum(np.log(c / s) + (c - 1) * np.log(x / s) - (x / s) ** c))
    assert ll == pytest.approx(at(c, s)) and all(at(c * f, s * g) < ll for f, g in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98)))


def test_five_families_on_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(1, t, float(v)) for t, v in enumerate(rng.gamma(2, 5, 300))] + [(2, t, 0.0 if t % 3 == 0 else float(v)) for t, v in enumerate(np.exp(rng.normal(2, 0.4, 300)))]
    rows += [(3, t, 1.0) for t in range(5)] + [(1, 300, None)]
    acc = spark.createDataFrame(rows, "node_id long, t int, acc double")
    fits = fitting.fit_cells(acc)
    by_node = {r.node_id: r for r in fits.collect()}
    assert by_node[1].dist_id == 0 and by_node[2].zero_fraction == pytest.approx(1 / 3) and by_node[3].dist_id == -1 and by_node[3].ppcc is None
    assert by_node[1].ppcc > 0.98 and by_node[1].ks_d_upper < 0.1
    spi = fitting.standardize(acc, fits)
    one = np.array([r.spi for r in spi.where("node_id = 1 AND spi IS NOT NULL").collect()])
    assert len(one) == 300 and abs(one.mean()) < 0.1 and abs(one.std() - 1) < 0.1
    assert spi.where("node_id = 3 AND spi IS NOT NULL").count() == 0


def erlang(n, x):
    """P(n, x) for a whole shape, exactly: one less the sum of the first n Poisson terms."""
    return 1 - sum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(n))


def test_the_incomplete_gamma_function_over_columns(spark):
    cases = [(a, a * f) for a in (1, 2, 7, 40, 300) for f in (0.01, 0.3, 0.9, 1.0, 1.1, 2.0, 6.0)]
    odd = [(0.05, 1e-8), (0.3, 0.2), (2.5, 1.7), (77.3, 90.0), (1234.5, 1200.0), (2e6, 2.001e6), (3.0, 1e9), (0.5, 0.0), (0.5, -1.0), (0.0, 1.0), (None, 1.0), (1.0, None), (1.0, float("nan"))]
    rows = spark.createDataFrame([(float(a), x) for a, x in cases], "a double, x double").select("a", "x", gamma_p(F.col("a"), F.col("x")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(erlang(int(r.a), r.x), abs=2e-12), r
    got = [r.p for r in spark.createDataFrame(odd, "a double, x double").select(gamma_p(F.col("a"), F.col("x")).alias("p")).collect()]
    for (a, x), p in zip(odd[:6], got, strict=False):
        assert p == pytest.approx(float(gamma_cdf(a, np.array([x]))[0]), rel=1e-9)
    assert got[3] == pytest.approx(0.9246, abs=1e-2) and got[6:9] == [1.0, 0.0, 0.0] and got[9:] == [None] * 4
    assert got[1] == pytest.approx(sum((-1) ** n * 0.2 ** (n + 0.3) / (math.factorial(n) * (n + 0.3)) for n in range(30)) / math.gamma(0.3), rel=1e-12)
    back = [(a, p) for a in (0.05, 0.4, 1.0, 3.3, 60.0, 2000.0) for p in (1e-6, 0.02, 0.5, 0.97, 1 - 1e-7)]
    table = spark.createDataFrame([*back, (1.0, 0.0), (1.0, 1.0), (-1.0, 0.5)], "a double, p double").select("p", gamma_p_inverse(F.col("a"), F.col("p")).alias("x"), gamma_p(F.col("a"), gamma_p_inverse(F.col("a"), F.col("p"))).alias("q")).collect()
    assert all(r.q == pytest.approx(r.p, rel=1e-8) for r in table[:-3]) and [r.x for r in table[-3:]] == [None] * 3


@pytest.mark.parametrize("family, params", [(0, [2.5, 3.0]), (1, [1.0, 0.7]), (2, [0.9, 4.0, 2.0]), (2, [-0.6, 9.0, 2.0]), (3, [1.4, 5.0]), (4, [1.3, 0.8, 2.0])])
def test_distributions_over_columns_equal_those_over_arrays(spark, family, params):
    x = np.array([0.3, 1.0, 2.2, 5.0, 9.5])
    p = np.array([0.01, 0.3, 0.5, 0.9, 0.999])
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, p, strict=True))], "k int, x double, p double")
    given = F.array(*map(F.lit, params))
    got = rows.select(fitting.distribution(F.lit(family), given, F.col("x")).alias("f"), fitting.quantile(F.lit(family), given, F.col("p")).alias("q")).collect()
    assert np.allclose([r.f for r in got], fitting.cdf(family, params, x), atol=1e-9) and np.allclose([r.q for r in got], fitting.ppf(family, params, p), rtol=1e-7)


def test_the_index_needs_no_python_worker_and_gaps_stay(spark):
    fits = spark.createDataFrame([(1, 3, [1.4, 5.0], 0.25), (2, 1, [1.0, 0.7], 0.0), (3, -1, None, None), (4, 0, [2.5, 3.0], 1.0)], "node_id long, dist_id int, params array<double>, zero_fraction double")
    acc = spark.createDataFrame([(n, t, v) for n in range(1, 6) for t, v in enumerate((0.0, 2.0, None, float("nan"), 50.0))], "node_id long, t int, acc double")
    index = fitting.standardize(acc, fits)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    normal = NormalDist()
    clip = lambda h: normal.inv_cdf(min(max(h, 1e-8), 1 - 1e-8))
    weibull = lambda v: 0.25 + 0.75 * (1 - math.exp(-((v / 5) ** 1.4)))
    got = {(r.node_id, r.t): r.spi for r in index.collect()}
    assert got[1, 0] == pytest.approx(clip(0.25), abs=1e-8) and got[1, 1] == pytest.approx(clip(weibull(2)), abs=1e-8) and got[2, 1] == pytest.approx((math.log(2) - 1) / 0.7, abs=1e-8)
    assert got[4, 1] == pytest.approx(clip(1), rel=1e-8) and all(got[n, t] is None for n, t in got if t in (2, 3) or n == 3) and len(got) == 20


def test_goodness_of_odd_records(spark):
    rows = [(1, t, 4.0) for t in range(40)] + [(2, t, 1e-300 if t % 2 else 1e300) for t in range(40)] + [(3, t, float(t % 3)) for t in range(40)]
    fits = {r.node_id: r for r in fitting.fit_cells(spark.createDataFrame(rows, "node_id long, t int, acc double")).collect()}
    assert fits[1].ppcc is None and set(fits) == {1, 2, 3}
    for r in fits.values():
        assert all(v is None or math.isfinite(v) for v in (r.ppcc, r.ks_d_upper, r.ad_a2, r.zero_fraction, *(r.params or []), *(r.aics or [])))


def densities(family, p, x):
    """Logarithms of the densities, written from the textbook forms."""
    lx = np.log(x)
    if family == 0:
        return (p[0] - 1) * lx - x / p[1] - math.lgamma(p[0]) - p[0] * math.log(p[1])
    if family == 1:
        return -lx - math.log(p[1] * math.sqrt(2 * math.pi)) - (lx - p[0]) ** 2 / (2 * p[1] ** 2)
    if family == 2:
        b, a = 2 / (p[0] * p[2]), 4 / p[0] ** 2
        y = b * (x - p[1] + a / b)
        return np.where(y > 0, math.log(abs(b)) + (a - 1) * np.log(np.maximum(y, 1e-300)) - y - math.lgamma(a), -np.inf)
    if family == 3:
        return math.log(p[0] / p[1]) + (p[0] - 1) * np.log(x / p[1]) - (x / p[1]) ** p[0]
    return math.log(p[1] / p[2]) - math.lgamma(p[0]) + (p[0] * p[1] - 1) * np.log(x / p[2]) - (x / p[2]) ** p[1]


def numeric_cdf(family, p, x):
    """Areas under the density between sorted places by many small trapezia over logarithms."""
    low = math.log(x[0]) - 40
    out, total, at = [], 0.0, low
    for v in x:
        u = np.linspace(at, math.log(v), 6000 if at == low else 60)
        total += np.trapezoid(np.exp(densities(family, p, np.exp(u)) + u), u) if math.log(v) > at else 0.0
        out.append(total)
        at = math.log(v)
    return np.array(out)


def test_registered_fits_index_and_medians(spark, sf_dir):
    acc = {}
    for r in catalog.QUERIES["rolling_accumulation"](spark, sf_dir).collect():
        acc.setdefault(r.node_id, {})[r.t] = r.acc
    fits = {r.node_id: r for r in catalog.QUERIES["distribution_fits"](spark, sf_dir).collect()}
    index = {(r.node_id, r.t): r.spi for r in catalog.QUERIES["spi"](spark, sf_dir).collect()}
    normal, good = NormalDist(), []
    assert set(fits) == set(acc) and len(index) == sum(map(len, acc.values()))
    for node, own in acc.items():
        values = np.array([v for v in own.values() if v is not None])
        x, r = np.sort(values[values > 0]), fits[node]
        if len(values) < 10 or len(x) < 6:
            assert r.dist_id == -1
            continue
        # the AIC is that of the parameters, no other family beats the choice, and no step from the parameters is better
        ll = densities(r.dist_id, r.params, x).sum()
        assert r.aics[r.dist_id] == pytest.approx(2 * len(r.params) - 2 * ll, rel=1e-6) and r.zero_fraction == pytest.approx((values == 0).mean())
        finite = [a for a in r.aics if a is not None]
        assert r.dist_id == 0 and r.aics[0] - min(finite) <= 2 or r.aics[r.dist_id] == min(finite)
        free = {2: (0, 2), 3: (0, 1), 4: (0, 1, 2)}.get(r.dist_id, ())
        for k in free:
            for f in (0.97, 1.03):
                moved = [v * f if j == k else v for j, v in enumerate(r.params)]
                assert densities(r.dist_id, moved, x).sum() <= ll + 1e-3 * abs(ll) ** 0.5
        n, i = len(x), np.arange(1, len(x) + 1)
        areas = np.clip(numeric_cdf(r.dist_id, r.params, x), 1e-12, 1 - 1e-12)
        assert r.ks_d_upper == pytest.approx(np.abs(areas - i / n).max(), abs=2e-3)
        assert r.ad_a2 == pytest.approx(-n - np.mean((2 * i - 1) * (np.log(areas) + np.log(1 - areas[::-1]))), rel=0.05, abs=0.5)
        assert 0.5 < r.ppcc <= 1
        good.append(r)
        for t in list(own)[::97]:
            v = own[t]
            if v is None:
                assert index[node, t] is None
            elif v <= 0:
                assert index[node, t] == pytest.approx(normal.inv_cdf(min(max(r.zero_fraction, 1e-8), 1 - 1e-8)), abs=1e-6)
            else:
                h = r.zero_fraction + (1 - r.zero_fraction) * float(np.interp(v, x, areas))
                assert index[node, t] == pytest.approx(normal.inv_cdf(min(max(h, 1e-8), 1 - 1e-8)), abs=0.03)
    summary = catalog.QUERIES["gof_summary"](spark, sf_dir).first()
    assert summary.valid_cells == len(good) > 5
    for name, column in (("zero_fraction", "zero_fraction"), ("selected_ppcc", "ppcc"), ("selected_ks_d", "ks_d_upper"), ("selected_ad_a2", "ad_a2")):
        assert summary[f"median_{name}"] == pytest.approx(np.median([g[column] for g in good if g[column] is not None]))


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in pairs:
        if a is not None:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
