import numpy as np
import pytest

from samplewright.operators import resampling as R


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(1234)
    values = rng.normal(1.0, 0.5, (3, 20))
    return values, spark.createDataFrame([(t, s, float(values[t, s])) for t in range(3) for s in range(20)], "t long, s long, v double")


def test_jackknife_error_is_the_standard_error(raw):
    values, df = raw
    got = {r["t"]: r for r in R.jackknife_error(R.jackknife(df, ["t"]), ["t"]).collect()}
    for t in range(3):
        assert got[t]["mean"] == pytest.approx(values[t].mean())
        assert got[t]["error"] == pytest.approx(values[t].std() / np.sqrt(19))


def test_raw_samples_come_back(raw):
    values, df = raw
    for r in R.unjackknife(R.jackknife(df, ["t"]), ["t"]).collect():
        assert r["v"] == pytest.approx(values[r["t"], r["s"]])


def test_bins_are_cropped(raw):
    values, df = raw
    got = R.binned(df, ["t"], 7).collect()
    assert len(got) == 3 * 2
    for r in got:
        assert r["v"] == pytest.approx(values[r["t"], 7 * r["s"] : 7 * r["s"] + 7].mean())


def test_closed_form_of_double_jackknife_covariance(raw):
    values, df = raw
    for r in R.double_jackknife_covariance(df, "t").collect():
        keep = [k for k in range(20) if k != r["s"]]
        inner = [[(values[t].sum() - values[t, r["s"]] - values[t, k]) / 18 for k in keep] for t in (r["t_i"], r["t_j"])]
        assert r["covariance"] == pytest.approx(np.cov(inner, bias=True)[0, 1] * 18)


def test_bootstrap_uses_one_table_for_all_series(spark, raw):
    values, df = raw
    table = R.resample_table(spark, 20, 5, 4)
    draws = {}
    for r in table.collect():
        draws.setdefault(r["b"], {})[r["pos"]] = r["s"]
    assert all(sorted(d) == list(range(20)) for d in draws.values())
    for r in R.bootstrap(df, table, ["t"]).collect():
        want = values[r["t"]].mean() if r["s"] < 0 else np.mean([values[r["t"], s] for s in draws[r["s"]].values()])
        assert r["v"] == pytest.approx(want)


def test_autocorrelation_starts_at_one(raw):
    _, df = raw
    first = [r for r in R.autocorrelation(df, ["t"], 3).collect() if r["lag"] == 0]
    assert len(first) == 3
    assert all(r["c"] == pytest.approx(1) and r["tau"] == pytest.approx(0.5) for r in first)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_autocorrelation_by_blocks_finds_all_pairs(spark, width):
    rng = np.random.default_rng(3)
    rows = [(t, int(s) - 20, float(v) if v > -1.5 else None) for t in range(2) for s, v in zip(rng.integers(0, 90, 80), rng.normal(5, 1, 80), strict=True)]
    got = {(r["t"], r["lag"]): (r["c"], r["tau"]) for r in R.autocorrelation(spark.createDataFrame(rows, "t long, s long, v double"), ["t"], 4, width).collect()}
    assert set(got) == {(t, lag) for t in range(2) for lag in range(5)}
    for t in range(2):
        own, tau = [(s, v) for k, s, v in rows if k == t and v is not None], 0
        mean, var = np.mean([v for _, v in own]), np.var([v for _, v in own])
        for lag in range(5):
            want = np.mean([(v - mean) * (w - mean) / var for a, v in own for b, w in own if b - a == lag])
            tau += 0.5 if lag == 0 else want
            assert got[t, lag] == pytest.approx((want, tau))


def test_autocorrelation_sends_a_sample_once(spark):
    """Not once a lag, and not the samples of one series to one task."""
    n = 100_000
    df = spark.range(n).selectExpr("0L AS t", "id AS s", "rand(5) AS v")
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert R.autocorrelation(df, ["t"], 10).count() == 11
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = stages()
    read = sum(found.apply(k).shuffleReadRecords() for k in range(found.size()) if found.apply(k).stageId() not in before)
    assert n <= read < 2 * n


def test_empty_tables(spark):
    none = spark.createDataFrame([], "t long, s long, v double")
    assert R.jackknife(none, ["t"]).count() == 0
    assert R.covariance(none, "t").count() == 0
    assert R.line_fit(none).count() == 0
