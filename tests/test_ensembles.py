import os

import pytest

from samplewright.operators import ensembles as E
from samplewright.operators import resampling as R
from samplewright.sources import sinks, text
from samplewright.streaming import moments

DATA = "/root/testdata/sf0.001"
SAMPLES = "t long, s long, v double"


def test_balanced_tables_draw_each_block_alike(spark):
    rows = E.balanced_table(spark, 23, 12, 4).collect()
    assert len(rows) == 12 * 20 and {r["pos"] for r in rows} == set(range(20))
    drawn = [r["s"] for r in rows]
    assert all(drawn.count(s) == 12 for s in range(20))
    assert any(len({r["s"] for r in rows if r["b"] == b}) < 20 for b in range(12))


def test_draws_of_neighbours_do_not_correlate(spark):
    import numpy as np

    s = np.array([r["s"] for r in R.resample_table(spark, 100, 200).orderBy("b", "pos").collect()], float)
    assert all(abs(np.corrcoef(s[:-k], s[k:])[0, 1]) < 0.03 for k in (1, 2, 3, 100))
    assert abs(s.mean() - 49.5) < 0.7


def test_layouts(spark):
    a = spark.createDataFrame([("x", 3), ("y", 5)], "tag string, size long")
    b = spark.createDataFrame([("y", 5), ("z", 7)], "tag string, size long")
    assert {tuple(r) for r in E.joined_layout(a, b).collect()} == {("x", 3), ("y", 5), ("z", 7)}
    clash = spark.createDataFrame([("y", 6)], "tag string, size long")
    with pytest.raises(Exception, match="ensemble of two sizes: y"):
        E.joined_layout(a, clash).collect()
    assert {r["tag"] for r in E.told_apart(a.unionByName(clash)).collect()} == {"x", "y_5", "y_6"}


def test_error_about_another_centre(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([1.0, 2.0, 4.0])] + [(0, -1, 3.0)], SAMPLES)
    row = E.error_about_centre(df, ["t"]).first()
    assert row["central"] == 3 and row["error"] == pytest.approx((2 / 3 * (4 + 1 + 1)) ** 0.5)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2.5), (0, 1, 1.5), (0, 0, 0.5)], SAMPLES)
    sinks.text_dump(df.coalesce(1), str(tmp_path / "text"), 2.0)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == ["0 0 1.0 0", "0 1 3.0 0", "1 0 5.0 0"]
    assert sorted(map(tuple, sinks.saved(df, str(tmp_path / "table")).collect())) == sorted(map(tuple, df.collect()))


def test_flow_files(spark, tmp_path):
    (tmp_path / "flow.1").write_text("0.5 2\n1 3\n1 3\n")
    (tmp_path / "flow.2").write_text("0.5 4\n1 5\n")
    found = text.flow(spark, str(tmp_path / "flow.*"), r"flow\.(\d+)$", False)
    assert sorted(map(tuple, found.collect())) == [(1, 0.5, 0.5), (1, 1.0, 3.0), (2, 0.5, 1.0), (2, 1.0, 5.0)]
    (tmp_path / "flow.3").write_text("1 5\n1 6\n")
    with pytest.raises(Exception, match="two values at t"):
        text.flow(spark, str(tmp_path / "flow.*"), r"flow\.(\d+)$").collect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_streams_give_what_tables_give(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_type AS t", "ts", "value AS v")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = moments.running(stream, ["t"]).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r["t"]: r for r in spark.table("running").collect()}
    for r in R.moments(events, ["t"]).collect():
        assert got[r["t"]]["mean"] == pytest.approx(r["mean"]) and got[r["t"]]["error"] == pytest.approx(r["standard_error"])
    daily = moments.windowed(stream, ["t"], "ts", "1 day", "60 days")
    query = daily.writeStream.format("memory").queryName("daily").outputMode("update").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    latest = {}
    for r in spark.table("daily").collect():
        latest[r["start"], r["t"]] = max(latest.get((r["start"], r["t"]), 0), r["n"])
    assert sum(latest.values()) == events.count()


def test_ensemble_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], SAMPLES)
    sources = spark.createDataFrame([], "tsrc long, " + SAMPLES)
    for df in (E.jackknife_with_centre(none, ["t"]), E.error_about_centre(none, ["t"]), E.block_double_jackknife_covariance(none, "t", 3), E.source_average(sources, True),
               E.correction(sources, sources), E.sample_corrected(none, none, none, ["t"]), moments.running(none, ["t"])):
        assert df.count() == 0


def test_single_samples_give_null(spark):
    one = spark.createDataFrame([(0, 0, 1.5)], SAMPLES)
    assert R.moments(one, ["t"]).first()["standard_error"] is None
    assert [r["v"] for r in R.jackknife(one, ["t"]).collect()] == [None]
    assert R.covariance(one, "t").first()["covariance"] is None
    assert E.block_double_jackknife_covariance(one, "t", 1).first()["covariance"] is None
    assert moments.running(one, ["t"]).first()["error"] is None
