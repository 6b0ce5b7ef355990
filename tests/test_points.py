"""Fits of several coordinates, frozen inputs, optimal operators and couplings, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.functions import couplings
from samplewright.operators import coordinates as Q
from samplewright.operators import fits as L
from samplewright.operators import projections as J
from samplewright.operators import resampling as R
from samplewright.operators import trust

GRID = [(t, sep) for sep in (6, 8, 10) for t in range(1, sep - 1)]


def slopes_agree(function, x, p):
    for k in range(len(function.names)):
        h = 1e-6 * (np.arange(len(function.names)) == k)
        assert function.slope(x, p)[:, :, k] == pytest.approx((function.value(x, p + h) - function.value(x, p - h)) / 2e-6, rel=1e-4, abs=1e-7)


@pytest.mark.parametrize(("sources", "sinks", "kinds", "constant"), [(1, 1, 1, False), (1, 1, 1, True), (1, 2, 1, False), (2, 1, 1, False), (2, 2, 1, False), (1, 1, 3, False), (2, 2, 2, True)])
def test_three_point_values_and_slopes(sources, sinks, kinds, constant):
    f = Q.three_point(sources, sinks, kinds, constant)
    assert len(f.names) == len(f.guess) == len(set(f.names)) == 2 * (sources + sinks) + sources * sinks * kinds + constant
    rng = np.random.default_rng(1)
    x = np.array([(*g, k) for g in GRID for k in range(kinds)], float)[:, : 3 if kinds > 1 else 2]
    p = rng.uniform(0.2, 1.2, (4, len(f.names)))
    slopes_agree(f, x, p)
    named = dict(zip(f.names, p[2], strict=True))
    i = lambda c, end, k, n: named[f"{c}_{end}{k if n > 1 else ''}"]
    for row, got in zip(x, f.value(x, p)[2], strict=True):
        t, sep, kind = row[0], row[1], int(row[2]) if kinds > 1 else 0
        want = named.get("C", 0.0)
        for a in range(sources):
            for b in range(sinks):
                m = named[f"M{f'{a}{b}' if sources > 1 or sinks > 1 else ''}{f'_{kind}' if kinds > 1 else ''}"]
                # As written with the separation: exp(-E_snk sep) exp(-(E_src - E_snk) t).
                want += i("A", "src", a, sources) * i("A", "snk", b, sinks) * m * np.exp(-i("E", "snk", b, sinks) * sep) * np.exp(-(i("E", "src", a, sources) - i("E", "snk", b, sinks)) * t) / 2**0.5
        assert got == pytest.approx(want)


def test_planted_truth_is_found_with_inputs_frozen_by_sample(spark):
    """Two sink states, three kinds; amplitudes and energies differ from sample to sample."""
    rng, n = np.random.default_rng(2), 25
    f = Q.three_point(1, 2, 3)
    known = {"A_src": rng.normal(1.2, 0.01, n), "E_src": rng.normal(0.35, 0.001, n), "A_snk0": rng.normal(0.9, 0.01, n), "E_snk0": rng.normal(0.3, 0.001, n), "A_snk1": rng.normal(0.5, 0.01, n), "E_snk1": rng.normal(0.8, 0.001, n)}
    truth = rng.normal(1.0, 0.3, 6)
    x = np.array([(*g, k) for g in GRID for k in range(3)], float)
    y = f.value(x, np.column_stack([*known.values(), np.tile(truth, (n, 1))])) * (1 + rng.normal(0, 1e-4, (n, len(x))))
    df = spark.createDataFrame([(int(a), int(b), int(k), s, float(y[s, j])) for j, (a, b, k) in enumerate(x) for s in range(n)], "t int, separation int, kind int, s long, v double")
    series, own = Q.placed(df, ["t", "separation", "kind"], f)
    stored = spark.createDataFrame([(name, s, float(v[s] ** 2)) for name, v in known.items() for s in range(n)], "name string, s long, v double")
    frozen = Q.frozen_values({name: Q.Frozen(stored, {"name": name}, "sqrt(x)") for name in known}, series)
    for minimizer in ("damped", "subspace"):
        rows = L.fitted(series, own, 0, len(x), "uncorrelated", L.Options(frozen=dict.fromkeys(known, 1.0)), frozen=frozen, minimizer=minimizer).collect()
        assert len(rows) == n and all(r["converged"] and r["dof"] == len(x) - 6 for r in rows)
        found = np.array([[r[name] for name in f.names[6:]] for r in rows])
        assert found == pytest.approx(np.tile(truth, (n, 1)), rel=0.02)
        assert [r["A_src"] for r in sorted(rows)] == pytest.approx(known["A_src"])


def test_two_and_three_point_functions_together(spark):
    """The energy of the source state is shared by both."""
    rng, n = np.random.default_rng(3), 20
    f = Q.joint([L.exponential(), Q.three_point()], [{"A": "Z", "E": "E"}, {"A_src": "Z", "E_src": "E", "A_snk": "Y", "E_snk": "W", "M": "M"}], [[0], [0, 1]])
    assert f.names == ("Z", "E", "Y", "W", "M")
    truth = np.array([1.1, 0.4, 1.0, 0.3, 0.7])
    x = np.array([(t, 0, 0) for t in range(8)] + [(*g, 1) for g in GRID], float)
    slopes_agree(f, x, rng.uniform(0.3, 1.0, (3, 5)))
    y = f.value(x, np.tile(truth, (n, 1))) * (1 + rng.normal(0, 1e-4, (n, len(x))))
    df = spark.createDataFrame([(*map(float, c), s, float(y[s, j])) for j, c in enumerate(x) for s in range(n)], "t double, separation double, kind double, s long, v double")
    series, own = Q.placed(df, ["t", "separation", "kind"], f)
    for r in L.fitted(series, own, 0, len(x), "uncorrelated", L.Options(frozen={"Y": 1.0})).collect():
        assert [r[k] for k in f.names] == pytest.approx(truth, rel=0.01)


def test_planes_and_points_without_coordinates(spark):
    x = np.array([(a, b) for a in range(3) for b in (-1.0, 0.5, 2.0)])
    f = Q.linear(2)
    slopes_agree(f, x, np.ones((2, 3)))
    df = spark.createDataFrame([(float(a), float(b), s, float(1.0 + 2 * a - 3 * b) + 1e-3 * ((7 * s + int(a) + int(2 * b) ** 2) % 5)) for a, b in x for s in range(8)], "a double, b double, s long, v double")
    series, own = Q.placed(df, ["a", "b"], f)
    p = L.fitted(series, own, 0, 9, "uncorrelated").first()
    assert (p["a0"], p["a1"], p["a2"]) == pytest.approx((1.0, 2.0, -3.0), abs=0.01)
    with pytest.raises(ValueError, match="coordinate"):
        Q.placed(df.withColumn("b", F.when(F.col("b") > 1, F.col("b"))), ["b"], f)


def test_ratio_needs_its_partners(spark):
    frame = lambda rows: spark.createDataFrame([(t, s, float(v)) for t, s, v in rows], "t int, s long, v double")
    three, two = frame([(1, 0, 12.0), (2, 0, 6.0)]), frame([(t, 0, t + 1.0) for t in range(5)])
    assert {r["t"]: r["v"] for r in Q.ratio(three, two, two, 4).collect()} == {1: 12 / (2 * 4), 2: 6 / (3 * 3)}
    with pytest.raises(Exception, match="only one quantity has t"):
        Q.ratio(three, two.where("t <> 1"), two, 4).collect()
    assert Q.ratio(frame([(1, 0, 1.0)]), frame([(1, 0, 0.0)]), frame([(3, 0, 1.0)]), 4).first()["v"] is None


def test_channel_averages_are_one_linear_map(spark):
    rng = np.random.default_rng(4)
    v = rng.normal([[2.0, 2.1, 1.9]], [[0.1, 0.3, 0.2]], (40, 3))
    df = spark.createDataFrame([(0, k, s, float(v[s, k])) for k in range(3) for s in range(40)], "t int, k int, s long, v double")
    w = 1 / (v.var(axis=0) / 39)
    got = {r["s"]: r["v"] for r in Q.averaged(df, "k", ["t"]).collect()}
    assert [got[s] for s in range(40)] == pytest.approx((v @ w) / w.sum())
    chi2 = (w * (v.mean(axis=0) - (v.mean(axis=0) @ w) / w.sum()) ** 2).sum()
    row = Q.consistency(R.jackknife(df, ["t", "k"]), "k", ["t"]).first()
    assert (row["chi2"], row["dof"]) == (pytest.approx(chi2), 2) and row["p"] == pytest.approx(np.exp(-chi2 / 2))
    assert Q.consistency(R.jackknife(df.where("k = 0"), ["t", "k"]), "k", ["t"]).first()["p"] is None
    flat = df.withColumn("v", F.when(F.col("k") == 1, 1.0).otherwise(F.col("v")))
    assert {r["v"] for r in Q.averaged(flat, "k", ["t"]).collect()} == {None}


def test_frozen_values_are_checked(spark):
    samples = spark.createDataFrame([(s, float(s)) for s in range(4)], "s long, v double")
    stored = spark.createDataFrame([(i, s, 10.0 * i + s) for i in range(2) for s in range(4)], "i int, s long, v double")
    rows = Q.frozen_values({"a": Q.Frozen(stored, {"i": 1}), "b": Q.Frozen(stored, {"i": 0}, "x^2 + 1"), "c": Q.Frozen(formula="3/4")}, samples).collect()
    assert {r["s"]: (r["a"], r["b"], r["c"]) for r in rows} == {s: (10.0 + s, s * s + 1.0, 0.75) for s in range(4)}
    for wrong, text in (({"a": Q.Frozen(formula="x")}, "formula of nothing"), ({"a": Q.Frozen()}, "formula of nothing"), ({"a": Q.Frozen(stored, {"i": 0}, "y")}, "of x alone"), ({"a": Q.Frozen(stored, {"i": 0}, "2")}, "of x alone")):
        with pytest.raises(ValueError, match=text):
            Q.frozen_values(wrong, samples)
    for table in (stored.where("s <> 2"), stored, stored.where("i = 0").unionByName(stored.where("i = 0 AND s = 1")), spark.createDataFrame([(0, 9, 1.0)], "i int, s long, v double")):
        with pytest.raises(Exception, match="not one value of a"):
            Q.frozen_values({"a": Q.Frozen(table)}, samples).collect()


def test_optimal_operators_see_one_state(spark):
    rng, rows, fitted = np.random.default_rng(5), [], []
    e = np.array([0.2, 0.5, 0.9])
    for s in range(5):
        a = rng.normal(size=(3, 3)) + 2 * np.eye(3)  # states by operators
        fitted += [(n, i, s, float(a[n, i])) for n in range(3) for i in range(3)]
        for t in range(4):
            c = a.T @ np.diag(np.exp(-e * t)) @ a
            rows += [(t, i, j, s, float(c[i, j])) for i in range(3) for j in range(3)]
    df, amplitudes = spark.createDataFrame(rows, "t int, i int, j int, s int, v double"), spark.createDataFrame(fitted, "n int, i int, s int, v double")
    for state in range(3):
        got = J.projected(df, J.optimal(amplitudes, state)).collect()
        assert len(got) == 20 and all(r["v"] == pytest.approx(np.exp(-e[state] * r["t"])) for r in got)
    # A sample that can't be inverted, or lacks an entry, has no row.
    odd = amplitudes.where("NOT (s = 1 AND n = 0 AND i = 0)").withColumn("v", F.when((F.col("s") == 2) & (F.col("n") == 1), 0.0).otherwise(F.col("v")))
    assert {r["s"] for r in J.optimal(odd).collect()} == {0, 3, 4}
    assert {r["s"] for r in J.projected(df.where("NOT (s = 3 AND i = 0 AND j = 1)"), J.optimal(amplitudes)).collect()} == {0, 1, 2, 4}


def test_couplings(spark):
    # The scale of four flavours 0.331416 gives 0.2265 or so at 4.18.
    rows = [(1, 4.18, 0.331416), (2, 2.0, 0.1), (3, 1.0, 1.5), (4, None, 0.3), (5, 0.5, 0.4)]
    df = spark.createDataFrame(rows, "s int, energy double, given double")
    df = df.withColumn("coupling", couplings.running(F.col("energy"), F.col("given"), 4))
    got = {r["s"]: r for r in couplings.matched_scale(df, "energy", "coupling", 4).collect()}
    assert got[1]["coupling"] == pytest.approx(0.2265, abs=2e-3)
    for s in (1, 2, 5):
        assert got[s]["scale"] == pytest.approx(got[s]["given"], abs=1e-6)
    assert got[3]["coupling"] is None and got[3]["scale"] is None and got[4]["scale"] is None
    high = couplings.matched_scale(df.select("s", "energy", F.lit(-1.0).alias("coupling")), "energy", "coupling", 4).collect()
    assert {r["scale"] for r in high} == {None}  # no scale gives a negative coupling


def test_minimum_is_found_for_all_at_once():
    rng = np.random.default_rng(6)
    at = rng.uniform(0.1, 9.9, 500)
    for f, accuracy in ((lambda x: (x - at) ** 2, 1e-7), (lambda x: np.abs(x - at), 1e-7), (lambda x: np.cosh(x - at), 1e-6), (lambda x: (x - at) ** 4 + x * 0, 1e-2)):
        x, known = couplings.minimum(f, np.zeros(500), np.full(500, 10.0))
        assert known.all() and np.abs(x - at).max() < accuracy
    assert trust.METHODS


def test_odd_masses(spark):
    t, m = np.arange(10), np.array([0.1, 0.4, 1.2])
    rows = [(int(k), s, float(np.sinh(m[s] * (7 - k)))) for k in t for s in range(3)]
    got = L.cosh_mass(spark.createDataFrame(rows, "t int, s long, v double"), 14, odd=True).collect()
    # At 6 the next value is sinh(0), at 7 the first one.
    assert sorted({r["t"] for r in got}) == [0, 1, 2, 3, 4, 5, 8]
    assert all(r["v"] == pytest.approx(m[r["s"]], rel=1e-6) for r in got)
