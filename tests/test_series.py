import math
import os

import duckdb
import numpy as np
import pytest

from samplewright.operators import resampling as R
from samplewright.operators import series as S
from samplewright.plans import catalog as registry
from samplewright.sources import text

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA)
    with duckdb.connect() as c:
        for t in ("lineitem", "events", "region"):
            c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
        found = c.sql(registry.ORACLES[name])
        columns, want = found.columns, found.fetchall()
    assert sorted(columns) == sorted(got.columns)
    have = [tuple(r) for r in got.select(*columns).collect()]
    assert len(have) == len(want)
    key = lambda r: ([str(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)])
    for a, b in zip(sorted(have, key=key), sorted(want, key=key), strict=True):
        assert all(x == (pytest.approx(y, rel=1e-6, abs=1e-3) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([(t, s, 10.0 * t + s) for t in range(4) for s in range(3)], "t long, s long, v double")


def test_lines_are_interpolated_and_carried_on(line):
    got = {(r["t"], r["s"]): r["v"] for r in S.interpolated(line, [-1.0, 0.0, 1.5, 3.0, 5.0]).collect()}
    assert got == {(x, s): pytest.approx(10 * x + s) for x in (-1.0, 0.0, 1.5, 3.0, 5.0) for s in range(3)}


def test_p_value_of_ties_takes_the_first(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([1.0, 2.0, 2.0, 4.0])], "t long, s long, v double")
    assert [S.p_value(df, x).first()["p"] for x in (0.0, 2.0, 3.0, 9.0)] == [0.75, 0.5, 0.5, 0.0]


def test_p_value_of_values_that_change_when_read_again(spark):
    def noise(batches):
        rng = np.random.default_rng()  # as sums do that add up in another order
        for batch in batches:
            yield batch.assign(v=batch["v"] + rng.normal(0, 1e-9, len(batch)))

    df = spark.createDataFrame([(t, s, 5.0 + s) for t in range(40) for s in range(4)], "t long, s long, v double").mapInPandas(noise, "t long, s long, v double")
    for target, p in ((0.0, 0.75), (5.9, 0.5), (6.1, 0.5), (9.0, 0.0)):
        assert [r["p"] for r in S.p_value(df, target).collect()] == [p] * 40


@pytest.mark.parametrize(
    ("values", "target", "p"),
    [([1.0, 2.0, 4.0], 1e17, 2 / 3), ([2.0, 4.0, 4.0], 3.0, 2 / 3), ([3.0, 3.0, 4.0, 4.0], 3.9, 0.25), ([1.0, None], 0.0, 0.5), ([None, None], 0.0, 0.5), ([-math.inf, math.inf, math.nan], 0.0, 2 / 3)],
)
def test_p_value_at_equal_distances_and_without_values(spark, values, target, p):
    df = spark.createDataFrame([(t, k, v) for t in (0, None) for k, v in enumerate(values)], "t long, s long, v double")
    assert [tuple(r) for r in S.p_value(df, target).collect()] == [(0, pytest.approx(p))]
    with duckdb.connect() as c:
        c.execute("CREATE TABLE li AS SELECT 0 AS t, unnest(?::DOUBLE[]) AS v", [values])
        sql = "WITH c " + registry.ORACLES["closest_p_value"].split(", c ", 1)[1].replace("35000.0", f"{target}::DOUBLE")
        assert c.sql(sql).fetchall() == [(0, pytest.approx(p))]


def test_scrambling_is_a_permutation(line):
    assert sorted(r["v"] for r in S.scrambled(line, 3).collect()) == sorted(r["v"] for r in line.collect())


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(0, 0, 0.0)], "t long, s long, v double")
    assert S.combined(df, df, "ratio").first()["v"] is None


def test_text_files(spark, tmp_path):
    for k in (10, 20, 40):
        (tmp_path / f"std.{k}").write_text(f"0 {k}.5 0\n1  2e1 7\n\n")
        (tmp_path / f"src.{k}").write_text("0 0 1 9\n0 1 2 9\n1 0 3 9\n1 1 4 9\n")
        (tmp_path / f"inl.{k}").write_text("5 6 7\n")
    found = text.standard(spark, str(tmp_path / "std.*"), r"std\.(\d+)$")
    assert sorted(tuple(r) for r in found.collect()) == sorted([(k, 0, k + 0.5) for k in (10, 20, 40)] + [(k, 1, 20.0) for k in (10, 20, 40)])
    assert {(r["t"], r["v"]) for r in text.multi_source(spark, str(tmp_path / "src.*"), r"src\.(\d+)$", 2).collect()} == {(0, 2.0), (1, 3.0)}
    assert {(r["t"], r["v"]) for r in text.multi_source(spark, str(tmp_path / "src.*"), r"src\.(\d+)$", 2, True).collect()} == {(0, 9.0), (1, 9.0)}
    assert {(r["t"], r["v"]) for r in text.inline(spark, str(tmp_path / "inl.*"), r"inl\.(\d+)$").collect()} == {(0, 5.0), (1, 6.0), (2, 7.0)}
    assert sorted((r["t"], r["s"]) for r in text.in_range(found, 10, 10, 50, True).collect()) == [(t, s) for t in range(2) for s in range(3)]
    assert {r["s"] for r in text.in_range(found, 10, 10, 30).collect()} == {0, 1}
    with pytest.raises(ValueError, match="3 whole trajectories instead of 4"):
        text.in_range(found, 10, 10, 50)
    (tmp_path / "xy").write_text("1 2\n 3\n")
    assert [tuple(r) for r in text.xy(spark, str(tmp_path / "xy")).collect()] == [(1.0, 2.0), (None, 3.0)]


def test_new_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], "t long, s long, v double")
    table = R.resample_table(spark, 4, 2)
    for df in (S.folded(none, 4), S.interpolated(none, [1.0]), S.slope(none, 1.0), S.p_value(none, 1.0), R.boot_jackknife(none, table, ["t"]), R.boot_covariance(none, table, "t")):
        assert df.count() == 0
