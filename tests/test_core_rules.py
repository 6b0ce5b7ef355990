"""What missing samples, constant series, unmatched coordinates and seeds give."""

import numpy as np
import pytest

from samplewright.operators import ensembles as E
from samplewright.operators import resampling as R
from samplewright.operators import series as S


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "t long, s long, v double")


def test_missing_samples_count_nowhere(frame):
    holey, whole = frame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (0, 3, None)]), frame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)])
    for of in (lambda df: R.jackknife(df, ["t"]), lambda df: R.moments(df, ["t"]), lambda df: R.covariance(df, "t"), lambda df: R.double_jackknife(df, ["t"]), lambda df: R.jackknife_error(R.jackknife(df, ["t"]), ["t"]),
               lambda df: R.binned(df, ["t"], 3), lambda df: E.jackknife_with_centre(df, ["t"]), lambda df: R.unjackknife(R.jackknife(df, ["t"]), ["t"])):
        assert sorted(of(holey).collect()) == sorted(of(whole).collect())
    assert {r["s"]: r["v"] for r in R.jackknife(holey, ["t"]).collect()} == {0: 2.5, 1: 2.0, 2: 1.5}


def test_what_divides_by_zero_is_null(frame):
    constant = frame([(t, s, 2.0) for t in range(2) for s in range(4)])
    jack = R.jackknife(constant, ["t"])
    assert {r["c"] for r in R.autocorrelation(constant, ["t"], 1).collect()} == {None}
    assert {r["v"] for r in R.weighted_average(jack, "t").collect()} == {None}
    assert {(r["a"], r["b"], r["chi2"]) for r in R.line_fit(jack).collect()} == {(None, None, None)}
    zero = frame([(0, 0, 0.0), (1, 0, 0.0)])
    assert R.effective_mass(zero).count() == 0
    assert {r["v"] for r in R.relative_difference(zero, zero, ["t"]).collect()} == {None}
    two = frame([(0, 0, 1.0), (0, 1, 2.0)])
    assert {r["v"] for r in R.jackknife_to_double(R.jackknife(two, ["t"]), ["t"]).collect()} == {None}
    assert R.moments(frame([(0, 0, 1.0)]), ["t"]).first()["standard_error"] is None


def test_one_bad_sample_takes_its_time_along(frame):
    rows = [(t, s, 3.0 - t) for t in range(3) for s in range(3)] + [(3, 0, 1.0), (3, 1, -1.0), (3, 2, 1.0)]
    got = R.effective_mass(frame(rows)).collect()
    assert {r["t"] for r in got} == {0, 1} and len(got) == 6


def test_unmatched_coordinates_are_an_error(frame):
    a, b = frame([(0, 0, 1.0), (1, 0, 2.0)]), frame([(0, 0, 1.0)])
    for of in (lambda: S.combined(a, b, "sum"), lambda: S.combined(b, a, "ratio"), lambda: R.relative_difference(a, b, ["t"])):
        with pytest.raises(Exception, match="only one quantity has t = 1"):
            of().collect()


def test_seeds_and_neighbours_are_independent(spark):
    n, m = 1000, 3000
    draws = {seed: np.array([R.drawn(k, n, seed) for k in range(m)]) for seed in (1, 2, 3)}
    sql = [r[0] for r in spark.range(m).selectExpr(R.draw("id", n, 2)).collect()]
    assert sql == draws[2].tolist()
    for a in draws.values():
        assert abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.06 and abs(a.mean() / n - 0.5) < 0.03
    for shift in range(5):
        assert np.mean(draws[1][shift:] == draws[2][: m - shift]) < 0.01
    far = [R.drawn(k + 2**40, n, 1) for k in range(m)]
    assert np.mean(np.array(far) == draws[1]) < 0.01


def test_scrambling_breaks_up_neighbours(frame):
    n = 500
    got = {int(r["v"]): r["s"] for r in S.scrambled(frame([(0, k, float(k)) for k in range(n)]), n).collect()}
    assert sorted(got.values()) == list(range(n))
    steps = np.diff([got[k] for k in range(n)])
    assert len(set(steps.tolist())) > n / 2
    other = {int(r["v"]): r["s"] for r in S.scrambled(frame([(0, k, float(k)) for k in range(n)]), n, seed=7).collect()}
    assert sum(got[k] == other[k] for k in range(n)) < 10


def test_numbers_by_ranges(frame):
    rows = [(t, k * 7 - 40, 0.0) for t in range(3) for k in range(30 * t)]
    got = S.numbered(frame(rows).withColumnRenamed("s", "id"), ["t"], "id", 16).collect()
    for t in range(3):
        own = sorted((r["id"], r["s"]) for r in got if r["t"] == t)
        assert [s for _, s in own] == list(range(30 * t))
