"""Fits, eigenvalues and super-ensembles against plain numpy."""

import numpy as np
import pytest

from samplewright.operators import eigen as G
from samplewright.operators import fits as L
from samplewright.operators import resampling as R
from samplewright.operators import superensembles as U

X = np.arange(10.0)


def decay(rng, n, a=1.0, m=0.3, noise=0.05):
    return a * np.exp(-m * X) * rng.normal(1.0, noise, (n, 10))


@pytest.fixture(scope="module")
def jack(spark):
    raw = decay(np.random.default_rng(1234), 100)
    values = (raw.sum(axis=0) - raw) / 99
    frame = lambda v: spark.createDataFrame([(t, s, float(v[s, t])) for t in range(10) for s in range(100)], "t long, s long, v double")
    return raw, values, frame(raw), frame(values)


def by_gradient(f, x, y, w, p, priors=(), free=None):
    """A minimum by plain Newton steps on numerical derivatives: slow, but another way."""
    free = list(range(len(p))) if free is None else free
    cost = lambda p: (y - f(x, p)) @ w @ (y - f(x, p)) + sum(((p[k] - v) / s) ** 2 for k, v, s in priors)
    p = np.array(p, float)
    for _ in range(200):
        h = 1e-5 * np.maximum(1.0, np.abs(p))
        g, hess = np.zeros(len(free)), np.zeros((len(free), len(free)))
        for i, k in enumerate(free):
            up, down = p.copy(), p.copy()
            up[k] += h[k]
            down[k] -= h[k]
            g[i] = (cost(up) - cost(down)) / (2 * h[k])
        j = np.stack([(f(x, p + h * (np.arange(len(p)) == k)) - f(x, p - h * (np.arange(len(p)) == k))) / (2 * h[k]) for k in free], axis=1)
        hess = 2 * j.T @ w @ j + np.diag([2 * sum(1 / s**2 for q, _, s in priors if q == k) for k in free])
        step = np.linalg.solve(hess, g)
        p[free] -= step
        if np.abs(step).max() < 1e-11:
            break
    return p, cost(p)


@pytest.mark.parametrize("strategy", ["frozen", "uncorrelated", "correlated"])
def test_exponential_by_another_minimiser(jack, strategy):
    raw, values, raw_df, jack_df = jack
    rows = sorted(L.fitted(raw_df if strategy == "correlated" else jack_df, L.exponential(), 1, 7, strategy).collect())
    assert len(rows) == 100 and all(r["converged"] and r["dof"] == 5 for r in rows)
    f = lambda x, p: p[0] * np.exp(-p[1] * x)
    cov = np.cov(values[:, 1:8].T, bias=True) * 99
    for r in rows[::9]:
        if strategy == "correlated":
            rest = np.delete(raw[:, 1:8], r["s"], axis=0)
            w = np.linalg.inv(np.cov(rest.T, bias=True) / 98)
        else:
            w = np.linalg.inv(cov) if strategy == "frozen" else np.diag(1 / np.diag(cov))
        p, chi2 = by_gradient(f, X[1:8], values[r["s"], 1:8], w, [0.9, 0.5])
        assert (r["A"], r["E"], r["chi2"]) == (pytest.approx(p[0], rel=1e-5), pytest.approx(p[1], rel=1e-5), pytest.approx(chi2, rel=1e-4))


def test_frozen_and_prior(jack, spark):
    _, values, _, jack_df = jack
    by_sample = spark.createDataFrame([(s, 0.7 + 0.001 * s) for s in range(100)], "s long, A double")
    options = L.Options(frozen={"A": 0.7}, priors={"E": (0.2, 0.001)}, guess=(0.9, 0.5))
    f = lambda x, p: p[0] * np.exp(-p[1] * x)
    w = np.linalg.inv(np.cov(values.T, bias=True) * 99)
    for r in sorted(L.fitted(jack_df, L.exponential(), 0, 9, options=options, frozen=by_sample).collect())[::13]:
        a = 0.7 + 0.001 * r["s"]
        p, chi2 = by_gradient(f, X, values[r["s"]], w, [a, 0.5], [(1, 0.2, 0.001)], [1])
        assert r["A"] == pytest.approx(a) and r["E"] == pytest.approx(p[1], rel=1e-6) and r["chi2"] == pytest.approx(chi2, rel=1e-5) and r["dof"] == 10


@pytest.mark.parametrize(
    ("function", "truth"),
    [(L.exponential(2), (1.0, 0.3, 0.5, 1.2)), (L.cosh(20), (1.0, 0.3)), (L.cosh(20, 1, True), (1.0, 0.3, 0.2)), (L.sinh(20), (1.0, 0.3)), (L.exponential(1, True), (1.0, 0.4, 0.1)), (L.polynomial(2), (1.0, -0.5, 0.1)), (L.parabola(), (1.0, 0.2, 3.0)), (L.dispersion(), (0.6, 0.9))],
)
def test_functions_find_the_truth_and_their_slopes(function, truth):
    p = np.array([truth])
    y = function.value(X, p)
    slope = function.slope(X, p)
    for k in range(len(truth)):
        h = np.zeros_like(p)
        h[0, k] = 1e-6
        assert np.allclose((function.value(X, p + h) - function.value(X, p - h)) / 2e-6, slope[:, :, k], atol=1e-7)
    start = p * 1.1 + 0.01
    found, chi2, good = L.fit(function, X, y, np.eye(10) * 1e6, guess=start)
    assert good[0] and chi2[0] < 1e-6 and np.allclose(found, p, rtol=1e-3)


def test_bounds_hold():
    f = L.exponential()
    y = f.value(X, np.array([[1.0, 0.3]]))
    for bounds, want in (({"E": (0.0, 0.2)}, 0.2), ({"E": (0.4, None)}, 0.4), ({"E": (None, 0.25)}, 0.25), ({"E": (0.0, 1.0)}, 0.3)):
        p, _, _ = L.fit(f, X, y, np.eye(10) * 1e4, L.Options(bounds=bounds, guess=(0.9, (bounds["E"][0] or bounds["E"][1] - 0.2) + 0.1)))
        assert p[0, 1] == pytest.approx(want, abs=2e-3)


def test_a_hopeless_fit_says_so():
    p, chi2, good = L.fit(L.exponential(), X, np.array([np.full(10, np.nan), X * 0 + 1]), np.eye(10))
    assert not good[0] and good[1] and p[1, 1] == pytest.approx(0, abs=1e-6)


def test_inverses():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 6))
    a = a @ a.T
    out, condition, residual = L.inverse(a)
    assert np.allclose(out, np.linalg.inv(a)) and condition == pytest.approx(np.linalg.cond(a)) and residual < 1e-8
    values = np.linalg.eigvalsh(a)
    cut, _, _ = L.inverse(a, cutoff=float(values[2]))
    assert np.linalg.matrix_rank(cut) == 3
    c = L.modified(a / np.outer(np.sqrt(np.diag(a)), np.sqrt(np.diag(a))), 0.3)
    assert np.allclose(np.diag(c), 1) and np.allclose(c, c.T)


def test_boots_keep_their_centre(spark):
    raw = np.random.default_rng(5).normal(1.0, 0.3, (100, 10))
    df = spark.createDataFrame([(t, s, float(raw[s, t])) for t in range(10) for s in range(100)], "t long, s long, v double")
    boots = R.bootstrap(df, R.resample_table(spark, 100, 60), ["t"])
    rows = {r["s"]: r for r in L.fitted(boots, L.polynomial(0), 0, 9, "uncorrelated", kind="bootstrap").collect()}
    values = {}
    for r in boots.collect():
        values.setdefault(r["s"], np.zeros(10))[r["t"]] = r["v"]
    w = 1 / np.var([v for s, v in values.items() if s >= 0], axis=0)
    for s in (-1, 0, 17):
        assert rows[s]["a0"] == pytest.approx((w * values[s]).sum() / w.sum())
    q2 = {r["s"]: r["chi2"] for r in L.refitted_q2(boots, L.polynomial(0), 0, 9, strategy="uncorrelated").collect()}
    assert len(q2) == 61 and q2[-1] == pytest.approx(rows[-1]["chi2"])
    centre, mean = rows[-1]["a0"], np.mean([v for s, v in values.items() if s >= 0], axis=0)
    moved = values[3] - mean + centre
    a = (w * moved).sum() / w.sum()
    assert q2[3] == pytest.approx((w * (moved - a) ** 2).sum())


def test_cosh_masses(spark):
    rows = [(t, s, float(np.cosh((0.3 + 0.01 * s) * (10 - t)))) for t in range(20) for s in range(5)] + [(25, s, 1.0 if s else -1.0) for s in range(5)] + [(26, s, 0.5) for s in range(5)]
    got = L.cosh_mass(spark.createDataFrame(rows, "t long, s long, v double"), 20).collect()
    assert {r["t"] for r in got} == set(range(19)) and all(r["v"] == pytest.approx(0.3 + 0.01 * r["s"], rel=1e-6) for r in got)


def test_fits_of_empty_tables(spark):
    none = spark.createDataFrame([], "t long, s long, v double")
    assert L.fitted(none, L.exponential(), 0, 5).count() == 0 and L.cosh_mass(none, 10).count() == 0
    assert G.sweep(spark.createDataFrame([], "t long, i long, j long, s long, v double"), 0, 1, 4).count() == 0


def test_sweeps_by_numpy(spark):
    rng = np.random.default_rng(9)
    n, energies, rows, c = 3, np.array([0.2, 0.5, 0.9]), [], {}
    for s in range(4):
        z = rng.normal(size=(n, n))
        for t in range(8):
            c[t, s] = (z * np.exp(-energies * t)) @ z.T
            rows += [(t, i, j, s, float(c[t, s][i, j])) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "t long, i long, j long, s long, v double")
    found = G.sweep(df, 0, 2, 7)
    for r in found.collect():
        want = np.sort(np.linalg.eigvals(np.linalg.solve(c[r["t0"], r["s"]], c[r["t"], r["s"]])).real)[::-1]
        assert r["value"] == pytest.approx(want[r["n"]], rel=1e-6) and r["residual"] < 1e-8
    general = {(r["t0"], r["t"], r["s"], r["n"]): r["value"] for r in G.sweep(df, 0, 2, 7, general=True).collect()}
    assert all(general[r["t0"], r["t"], r["s"], r["n"]] == pytest.approx(r["value"], rel=1e-6) for r in found.collect())
    for r in G.effective_energies(found).collect():
        assert r["v"] == pytest.approx(energies[r["n"]], rel=1e-5)
    # One state's amplitudes come back up to a sign.
    for r in G.amplitudes(df, found).where("t0 = 1 AND t = 3").collect():
        assert r["v"] is not None
    bad = df.where("NOT (t = 2 AND s = 1)").unionByName(df.where("t = 2 AND s = 1").withColumn("v", -df["v"]))
    assert {(r["t0"], r["t"]) for r in G.sweep(bad, 0, 2, 4).select("t0", "t").distinct().collect()} == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4)}


def test_super_double_jackknife_agrees_with_the_single_one(spark):
    rows = [(0, s, float(s * s)) for s in range(6)]
    df = spark.createDataFrame(rows, "t long, s long, v double")
    members = U.contiguous(spark, 3, 6)
    single = {r["s"]: r["v"] for r in U.super_jackknife(df, members, 12, ["t"]).collect()}
    double = {(r["s"], r["inner"]): r["v"] for r in U.super_double_jackknife(df, members, 12, ["t"]).collect()}
    assert len(double) == 12 * 11
    for (o, i), v in double.items():
        gone = [k - 3 for k in (o, i) if 3 <= k < 9]
        assert v == pytest.approx(np.mean([s * s for s in range(6) if s not in gone]))
    assert single[0] == pytest.approx(np.mean([s * s for s in range(6)])) and single[3] == pytest.approx(np.mean([s * s for s in range(1, 6)]))


def test_mapped_members_take_the_first(spark):
    data_map = spark.createDataFrame([(0, 5, "a", 2), (0, 4, "a", 1), (1, 6, "a", 3), (2, 7, "b", 4)], "outer long, inner long, tag string, place long")
    assert sorted(map(tuple, U.mapped(data_map, "a").collect())) == [(0, 4), (1, 6)]


def test_simultaneous_fits_share_parameters(spark):
    rng = np.random.default_rng(11)
    x = np.arange(8.0)
    rows = []
    for s in range(60):
        for k, a in enumerate((1.0, 2.0)):
            v = a * np.exp(-0.3 * x) * (1 + 0.001 * rng.normal(size=8))
            rows += [(k, float(t), s, float(y)) for t, y in zip(x, v, strict=True)]
    df = spark.createDataFrame(rows, "series long, t double, s long, v double")
    both = L.simultaneous([L.exponential(), L.exponential()], [{"A": "A0", "E": "E"}, {"A": "A1", "E": "E"}])
    assert both.names == ("A0", "E", "A1")
    got = L.fitted(L.together(df), both, 0, 1e7, "uncorrelated").collect()
    assert len(got) == 60 and all(r["converged"] and r["dof"] == 13 for r in got)
    for r in got:
        assert (r["A0"], r["E"], r["A1"]) == (pytest.approx(1, abs=0.01), pytest.approx(0.3, abs=0.005), pytest.approx(2, abs=0.02))
    p = np.array([[1.1, 0.2, 1.7]])
    at = np.concatenate([x, x + L.APART])
    for k in range(3):
        h = np.zeros_like(p)
        h[0, k] = 1e-6
        assert np.allclose((both.value(at, p + h) - both.value(at, p - h)) / 2e-6, both.slope(at, p)[:, :, k], atol=1e-7)
