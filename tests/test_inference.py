"""P-values by resampling, covariance strategies, trust regions, roots and eigenvalue problems without symmetry, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.operators import eigen as G
from samplewright.operators import fits as L
from samplewright.operators import matrices as M
from samplewright.operators import pvalues as V
from samplewright.operators import resampling as R
from samplewright.operators import roots as Z
from samplewright.operators import trust
from samplewright.operators import weights as H

from tests.test_fits import X, by_gradient, decay

F2 = lambda x, p: p[0] * np.exp(-p[1] * x)


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(7)
    common = rng.normal(0, 0.03, (60, 1))
    values = decay(rng, 60) * (1 + common)
    return values, spark.createDataFrame([(t, s, float(values[s, t])) for t in range(10) for s in range(60)], "t long, s long, v double")


def mean_covariance(v):
    return np.cov(v.T, bias=True) / (len(v) - 1)


def scaled_to(correlation_of, sigma_of):
    """Correlations of one covariance matrix with the errors of another."""
    ratio = np.sqrt(np.diag(sigma_of) / np.diag(correlation_of))
    return correlation_of * np.outer(ratio, ratio)


@pytest.mark.parametrize("strategy", ["correlated", "block", "hybrid"])
def test_each_sample_has_its_own_matrix(raw, strategy):
    values, df = raw
    size, points = 4, slice(1, 6)
    bins = values[:, points].reshape(15, size, 5).mean(axis=1)
    rows = {r["s"]: r for r in L.fitted(df, L.exponential(), 1, 5, strategy, size=size).collect()}
    assert sorted(rows) == list(range(15)) and all(r["converged"] and r["dof"] == 3 for r in rows.values())
    for k in range(0, 15, 4):
        rest = np.delete(bins, k, axis=0)
        single = np.delete(values[:, points], range(size * k, size * k + size), axis=0)
        own, block = mean_covariance(rest), mean_covariance(single)
        # The double jackknife's inner means are over all but two bins, the block one's over all but a block and one.
        matrix = {"correlated": own, "block": block, "hybrid": scaled_to(block, own)}[strategy]
        p, chi2 = by_gradient(F2, X[points], rest.mean(axis=0), np.linalg.inv(matrix), [1.0, 0.3])
        assert (rows[k]["A"], rows[k]["E"], rows[k]["chi2"]) == pytest.approx((*p, chi2), rel=1e-5)


def test_changed_matrices(raw, spark):
    values, df = raw
    jack = R.jackknife(df, ["t"])
    triangle = M.normalised(R.covariance(jack, "t", "jackknife"))
    c = mean_covariance(values[:, 1:6])
    sigma = np.sqrt(np.diag(c))
    correlation = c / np.outer(sigma, sigma)
    cut = float(np.linalg.eigvalsh(correlation)[1] * 1.01)
    inverted = np.linalg.inv(correlation)
    given = spark.createDataFrame([(i + 1, j + 1, float(inverted[i, j]), float(sigma[i]), float(sigma[j])) for i in range(5) for j in range(i, 5)], "t_i long, t_j long, correlation double, sigma_i double, sigma_j double")
    cases = {
        "imported": ({"imported": triangle}, np.linalg.inv(correlation)),
        "inverted": ({"imported": given, "inverted": True}, inverted),
        "cut": ({"cutoff": cut}, H.inverse(correlation, cut)[0]),
        "modified": ({"modify": cut}, np.linalg.inv(H.modified(correlation, cut))),
        "uncorrelated": ({"imported": triangle, "strategy": "uncorrelated"}, np.eye(5)),
    }
    y = (values.sum(axis=0) - values)[:, 1:6] / 59
    for name, (more, inverse) in cases.items():
        rows = {r["s"]: r for r in L.fitted(jack, L.exponential(), 1, 5, **more).collect()}
        p, chi2 = by_gradient(F2, X[1:6], y[7], inverse / np.outer(sigma, sigma), [1.0, 0.3])
        assert (rows[7]["A"], rows[7]["E"], rows[7]["chi2"]) == pytest.approx((*p, chi2), rel=1e-5), name
    with pytest.raises(ValueError, match="shrink"):
        L.fitted(jack, L.exponential(), 1, 5, shrink=True)
    with pytest.raises(ValueError, match="strategy"):
        H.correlations(df, "frozen")


def test_boots_have_their_own_matrices(raw, spark):
    values, df = raw
    table = R.resample_table(spark, 60, 9)
    draws = {}
    for r in table.collect():
        draws.setdefault(r["b"], []).append(r["s"])
    rows = {r["s"]: r for r in L.fitted(df, L.exponential(), 1, 5, "correlated", table=table).collect()}
    assert sorted(rows) == list(range(-1, 9))
    for b in (-1, 0, 5):
        own = values[draws[b] if b >= 0 else slice(None), 1:6]
        p, chi2 = by_gradient(F2, X[1:6], own.mean(axis=0), np.linalg.inv(mean_covariance(own)), [1.0, 0.3])
        assert (rows[b]["A"], rows[b]["E"], rows[b]["chi2"]) == pytest.approx((*p, chi2), rel=1e-5)
    with pytest.raises(ValueError, match="boots"):
        H.correlations(df, "block", 4, table)


@pytest.mark.parametrize(("strategy", "size"), [("frozen", 1), ("uncorrelated", 4), ("block", 4), ("hybrid", 4)])
def test_p_value_is_resampling_refitting_and_counting(raw, spark, strategy, size):
    values, df = raw
    table = R.resample_table(spark, 60, 12, size)
    draws = {}
    for r in table.collect():
        draws.setdefault(r["b"], {})[r["pos"]] = r["s"]
    draws = {b: [d[k] for k in range(60)] for b, d in draws.items()} | {-1: list(range(60))}

    def fit_of(order, shift=0.0):
        own = values[order][:, 1:6]
        bins = own.reshape(60 // size, size, 5).mean(axis=1)
        c, b = mean_covariance(own), mean_covariance(bins)
        matrix = {"frozen": b, "uncorrelated": np.diag(np.diag(b)), "block": c, "hybrid": scaled_to(c, b)}[strategy]
        return by_gradient(F2, X[1:6], bins.mean(axis=0) + shift, np.linalg.inv(matrix), [1.0, 0.3])

    centre, q2 = fit_of(draws[-1])
    shift = F2(X[1:6], centre) - values[:, 1:6].mean(axis=0)
    want = {b: fit_of(d, shift)[1] for b, d in draws.items() if b >= 0}
    found = V.resampled_q2(df, table, L.exponential(), 1, 5, strategy, size)
    got = {r["s"]: r["chi2"] for r in found.collect()}
    assert got[-1] == pytest.approx(q2, rel=1e-6) and sorted(got) == sorted(draws)
    for b, c in want.items():
        assert got[b] == pytest.approx(c, rel=1e-4, abs=1e-6)
    order = np.sort(list(want.values()))
    assert V.placed(found).collect()[0]["p"] == pytest.approx((12 - int(np.abs(order - q2).argmin()) - 1) / 12)
    plain = {r["s"]: r["chi2"] for r in V.resampled_q2(df, table, L.exponential(), 1, 5, strategy, size, recentred=False).collect()}
    assert plain[0] == pytest.approx(fit_of(draws[0])[1], rel=1e-5)


def test_p_value_without_points(spark, raw):
    assert V.resampled_q2(raw[1], R.resample_table(spark, 60, 3), L.exponential(), 50, 60).collect() == []


@pytest.mark.parametrize("method", trust.METHODS)
@pytest.mark.parametrize(
    ("function", "start", "truth"),
    [(L.exponential(), None, [1.3, 0.4]), (L.cosh(12.0), None, [0.7, 0.5]), (L.exponential(2), [1.0, 0.3, 1.0, 1.5], [1.0, 0.35, 0.6, 1.2]), (L.polynomial(3), None, [1.0, -2.0, 0.5, 0.1]), (L.parabola(), [0.0, 1.0, 2.0], [1.0, 0.3, 4.0])],
)
def test_trust_regions_find_the_minimum(method, function, start, truth):
    rng = np.random.default_rng(4)
    y = function.value(X, np.tile(truth, (30, 1))) * (1 + rng.normal(0, 1e-3, (30, 10)))
    weight = np.linalg.inv(np.diag((1e-3 * np.abs(y.mean(axis=0)) + 1e-6) ** 2) * 0.7 + 0.3 * np.outer(*[1e-3 * np.abs(y.mean(axis=0)) + 1e-6] * 2))
    options = L.Options(guess=start) if start else L.Options()
    p, chi2, good = trust.fit(function, X, y, weight, options, method=method)
    _, least, fine = L.fit(function, X, y, weight, L.Options(guess=truth))
    assert good.all() and fine.all()
    assert chi2 == pytest.approx(least, rel=1e-5, abs=1e-7)


def test_trust_regions_go_on_where_parameters_are_nearly_one():
    """Two states of nearly one energy: the slopes' square loses what the slopes still have."""
    rng = np.random.default_rng(5)
    f = L.exponential(2)
    x = np.linspace(0, 10, 30)
    y = f.value(x, np.tile([1.0, 0.5, 1.0, 0.52], (20, 1))) + rng.normal(0, 1e-8, (20, 30))
    w = np.eye(30) * 1e16
    options = L.Options(guess=[0.9, 0.45, 1.1, 0.55])
    assert L.fit(f, x, y, w, options)[2].sum() < 20
    for method in trust.METHODS:
        _, chi2, good = trust.fit(f, x, y, w, options, method=method)
        assert good.all() and chi2.max() < 60


def test_trust_regions_heed_bounds_priors_frozen_values_and_bad_samples():
    x, f = np.arange(6.0), L.exponential()
    y = f.value(x, np.array([[1.0, 0.3], [1.0, 0.6], [np.nan, 0.5]]))
    options = L.Options(bounds={"E": (0.0, 0.4)}, priors={"A": (1.2, 0.05)})
    p, chi2, good = trust.fit(f, x, y, np.eye(6) * 1e4, options, method="dogleg")
    q, other, _ = L.fit(f, x, y[:2], np.eye(6) * 1e4, options)
    assert good.tolist() == [True, True, False] and p[:2, 1].max() <= 0.4
    assert chi2[:2] == pytest.approx(other, rel=1e-5)
    frozen, _, fine = trust.fit(f, x, y[:2], np.eye(6), L.Options(frozen={"A": 1.0}), frozen=np.array([[1.0], [1.0]]))
    assert fine.all() and frozen[:, 1] == pytest.approx([0.3, 0.6], rel=1e-5)
    with pytest.raises(ValueError, match="method"):
        trust.fit(f, x, y, np.eye(6), method="bfgs")


def test_terms_make_up_chi_square():
    rng = np.random.default_rng(6)
    f, p = L.exponential(), np.array([[1.1, 0.4], [0.9, 0.2]])
    x, y, sigma = np.arange(5.0), rng.normal(1, 0.1, (2, 5)), rng.uniform(0.1, 0.3, 5)
    a = rng.normal(size=(5, 5))
    c = a @ a.T
    c /= np.sqrt(np.outer(np.diag(c), np.diag(c)))
    priors = [(1, 0.3, 0.2)]
    t, j = trust.terms(f, x, y, p, sigma, c, priors)
    r = (y - f.value(x, p)) / sigma
    assert (t**2).sum(axis=1) / 2 == pytest.approx(np.einsum("si,ij,sj->s", r, np.linalg.inv(c), r) + ((p[:, 1] - 0.3) / 0.2) ** 2)
    for k in range(2):
        h = 1e-6 * (np.arange(2) == k)
        up, down = (trust.terms(f, x, y, p + d * h, sigma, c, priors)[0] for d in (1, -1))
        assert j[:, :, k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_roots(spark):
    rows = [(0, 2.0, 1.0), (1, 9.0, 0.5), (2, -1.0, 1.0), (3, None, 1.0), (4, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "s long, a double, b double")
    got = {r["s"]: r for r in Z.solved(df, lambda x, g: x**2 - g[:, :1], ["a"], {"x": 1.0}, 1e-8).collect()}
    assert (got[0]["x"], got[1]["x"]) == pytest.approx((2**0.5, 3.0)) and got[0]["residual"] < 1e-8 and got[1]["b"] == 0.5
    assert got[2]["x"] is None and got[2]["residual"] >= 1 and got[3]["x"] is None and got[4]["x"] is None and got[3]["residual"] is None
    # A circle and a line, each row its own radius; no root where they don't meet.
    both = lambda x, g: np.stack([x[:, 0] ** 2 + x[:, 1] ** 2 - g[:, 0], x[:, 0] - g[:, 1] * x[:, 1] - 0.5], axis=1)
    for r in Z.solved(df.where("s < 3"), both, ["a", "b"], {"x": 1.0, "y": 0.5}, 1e-8).collect():
        if r["s"] < 2:
            assert r["x"] ** 2 + r["y"] ** 2 == pytest.approx(r["a"]) and r["x"] - r["b"] * r["y"] == pytest.approx(0.5)
        else:
            assert r["x"] is None and r["y"] is None
    assert Z.solved(df.where("false"), both, ["a", "b"], {"x": 1.0, "y": 0.5}).collect() == []
    with pytest.raises(ValueError, match="there already"):
        Z.solved(df, both, ["a"], {"s": 1.0})


def test_energies_less_a_fixed_time(spark):
    e, rng = np.array([0.3, 0.8]), np.random.default_rng(1)
    values = []
    for s in range(4):
        a = rng.normal(size=(2, 2)) + 2 * np.eye(2)
        for t in range(9):
            c = a.T @ np.diag(np.exp(-(e + 0.01 * s) * t)) @ a + 5.0 * s  # the constant goes with the difference
            values += [(t, i, j, s, float(c[i, j])) for i in range(2) for j in range(2)]
    df = spark.createDataFrame(values, "t int, i int, j int, s int, v double")
    found = G.subtracted_energies(G.sweep(G.less_time(df, 8), 0, 1, 6), 8)
    rows = found.collect()
    assert len(rows) == (6 + 5) * 4 * 2
    for r in rows:
        assert r["v"] == pytest.approx(e[r["n"]] + 0.01 * r["s"], rel=1e-5)
    # Eigenvalues that no energy has: null, where the time is subtracted itself: no row.
    odd = spark.createDataFrame([(0, 1, 0, 0, -3.0), (0, 1, 0, 1, 0.5), (0, 8, 0, 0, 0.5)], "t0 int, t int, s int, n int, value double")
    got = {(r["t"], r["n"]): r["v"] for r in G.subtracted_energies(odd, 8).collect()}
    assert got[1, 0] is None and got[1, 1] is not None and len(got) == 2


def test_problems_without_symmetry(spark):
    rng = np.random.default_rng(3)
    matrices = rng.normal(size=(3, 6, 3, 3))
    rows = [(t, int(i), int(j), s, float(matrices[t, s, i, j])) for t in range(3) for s in range(6) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(rows, "t int, i int, j int, s int, v double")
    for r in G.sweep(df, 0, 1, 2, general=True).collect():
        a, b = matrices[r["t"], r["s"]], matrices[r["t0"], r["s"]]
        v, x = np.array([c["re"] + 1j * c["im"] for c in r["vector"]]), complex(r["value"], r["imaginary"])
        assert np.abs(a @ v - x * (b @ v)).max() < 1e-9 and r["residual"] < 1e-9
        assert np.linalg.norm(v) == pytest.approx(1) and v[np.abs(v).argmax()].imag == pytest.approx(0, abs=1e-12)
    for s in range(6):
        own = sorted((r["n"], complex(r["value"], r["imaginary"])) for r in G.eigenvalues(df.where("t = 0"), ["t", "s"], general=True).where(F.col("s") == s).collect())
        sizes = [abs(x) for _, x in own]
        assert sizes == sorted(sizes, reverse=True) and sum(x for _, x in own) == pytest.approx(np.trace(matrices[0, s]))
    # A turn has no real eigenvalues; a matrix that can't be inverted has no row.
    assert [complex(round(x.real, 9), round(x.imag, 9)) for x in G.solve_general(np.array([[0.0, -1.0], [1.0, 0.0]]))[0]] == [1j, -1j]
    assert G.solve_general(np.eye(2), np.zeros((2, 2))) is None and G.solve_general(np.full((2, 2), np.nan)) is None
