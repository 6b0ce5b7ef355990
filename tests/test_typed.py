"""Typed tables and readers by momenta on fixture files."""

import pytest
from pyspark.sql import functions as F

from samplewright.functions import expressions as X
from samplewright.operators import resampling as R
from samplewright.sources import momenta as P
from samplewright.sources import typed as T


def samples(spark, kind, n=4, indices=("i",)):
    columns, central = T.KINDS[kind]
    rows = spark.range(2).select(F.col("id").cast("int").alias("i"), F.explode(F.lit(list(range(-1 if central else 0, n))).cast("array<long>")).alias("s"))
    rows = rows.withColumn("kind", F.lit("J")).withColumn("ens", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = rows.withColumn("inner", F.explode(F.lit(list(range(n))).cast("array<long>"))).where("inner <> s" if "inner" in columns else "inner = 0")
    rows = rows.where("ens = 'a'" if "ens" not in columns else "true").withColumn("v", F.col("s") + 10.0 * F.col("i"))
    return rows.select(*indices, *columns, "v")


@pytest.mark.parametrize("kind", list(T.KINDS))
def test_every_kind_round_trips(spark, tmp_path, kind):
    df = T.described(samples(spark, kind), kind, ["i"])
    got = T.saved(df, str(tmp_path / "t"))
    facts = T.description(got)
    assert facts["kind"] == kind and facts["indices"] == ["i"] and set(facts["layout"].values()) == {4}
    assert len(facts["layout"]) == (2 if "ens" in T.KINDS[kind][0] else 1)
    assert T.kind_and_depth(got) == (kind, 1) and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    # The description survives filters and joins.
    assert T.description(got.where("i = 1").join(spark.range(2).select(F.col("id").cast("int").alias("i")), "i")) == facts
    for other in set(T.KINDS) - {kind}:
        with pytest.raises(ValueError, match="kind"):
            T.loaded(spark, str(tmp_path / "t"), other)
    with pytest.raises(ValueError, match="depth"):
        T.loaded(spark, str(tmp_path / "t"), kind, 2)


def test_what_a_kind_lacks_is_an_error(spark):
    jack, boots = samples(spark, "jackknife"), samples(spark, "bootstrap")
    for df, kind, text in ((jack, "double_jackknife", "columns"), (jack, "bootstrap", "a central row"), (boots, "jackknife", "no central row"), (jack, "other", "kind must be")):
        with pytest.raises(ValueError, match=text):
            T.described(df, kind, ["i"])
    with pytest.raises(ValueError, match="without a description"):
        T.description(jack)
    with pytest.raises(ValueError, match="without a description"):
        T.saved(jack, "/nowhere")


def test_tables_that_dont_agree_dont_meet(spark):
    a, b = T.described(samples(spark, "jackknife"), "jackknife", ["i"]), T.described(samples(spark, "jackknife", 5), "jackknife", ["i"])
    T.agreeing(a, a)
    with pytest.raises(ValueError, match="layout"):
        T.agreeing(a, b)
    raw = samples(spark, "raw", 6)
    one, two = R.resample_table(spark, 6, 4), R.resample_table(spark, 6, 4, seed=9)
    boots = lambda table: T.described(R.bootstrap(raw, table, ["i"]), "bootstrap", ["i"], table)
    T.agreeing(boots(one), boots(one.repartition(3)))
    with pytest.raises(ValueError, match="table"):
        T.agreeing(boots(one), boots(two))
    with pytest.raises(ValueError, match="kind"):
        T.agreeing(a, boots(one))


def test_two_indices_become_one(spark, tmp_path):
    df = samples(spark, "jackknife").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i")))).withColumn("v", F.col("v") + 100.0 * F.col("j"))
    df = T.saved(T.described(df, "jackknife", ["i", "j"]), str(tmp_path / "t"), ["i"])
    assert T.kind_and_depth(df) == ("jackknife", 2)
    flat = T.flattened(df, "k")
    assert T.kind_and_depth(flat) == ("jackknife", 1) and T.description(flat)["layout"] == {"all": 4}
    assert {(r["k"], r["v"]) for r in flat.where("s = 0").collect()} == {(0, 0.0), (1, 10.0), (2, 110.0)}
    assert T.flattened(flat) is flat


def test_names_of_a_formula_are_stored_series(spark, tmp_path):
    for name, kind, n in (("a", "jackknife", 4), ("b", "jackknife", 4), ("c", "jackknife", 5), ("d", "raw", 4)):
        T.saved(T.described(samples(spark, kind, n), kind, ["i"]), str(tmp_path / name))
    path = lambda n: str(tmp_path / n)
    found = T.picked(spark, {"x": (path("a"), {"i": 1}), "y": (path("b"), {"i": 0})})
    assert {r["s"]: r["v"] for r in X.calculated("x - 2*y", found, ["s"]).collect()} == {s: 10.0 + s - 2 * s for s in range(4)}
    for sources, text in (
        ({"x": (path("a"), {"i": 1}), "y": (path("c"), {"i": 0})}, "layout"), ({"x": (path("a"), {"i": 1}), "y": (path("d"), {"i": 0})}, "kind"),
        ({"x": (path("a"), {})}, "values for i"), ({"x": (path("a"), {"i": 1, "j": 2})}, "values for i"), ({"x": (path("a"), {"i": 7})}, "no series"),
    ):
        with pytest.raises(ValueError, match=text):
            T.picked(spark, sources)


TEMPLATE = "traj_<TRAJ>_Figure<FIG>_sep<TSEP>_p1src<P1SRC>_p2src<P2SRC>_p1snk<P1SNK>_p2snk<P2SNK>"
SHORT = "traj_<TRAJ>_Figure<FIG>_sep<TSEP>_mom<P1SRC>_mom<P1SNK>"


def test_momenta_in_names():
    assert P.written((1, -1, 0)) == "1_10" and P.written((-2, -2, -2)) == "_2_2_2"
    for wrong, text in (("traj_<TRAJ>_<P1SRC>", "lacks <P1SNK>"), ("<TRAJ><P1SRC><P1SNK><WHAT>", "no part")):
        with pytest.raises(ValueError, match=text):
            P._pattern(wrong)


def opposite(p):
    return tuple(-x for x in p)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of two trajectories; the value tells the file's momenta."""
    at = tmp_path_factory.mktemp("figures")
    value = lambda traj, a, b: traj + sum(10.0**-k * (x + 3) for k, x in enumerate((*a, *b), 1))
    there = [((1, 1, 1), (1, 1, 1)), ((1, 1, 1), (-1, -1, -1)), ((-1, 1, 1), (1, 1, 1)), ((1, -1, 1), (1, 1, 1))]
    for traj in (10, 20):
        for a, b in there:
            lines = "".join(f"{src} {t} {value(traj, a, b) + t} {-t}.5\n" for src in range(2) for t in range(3))
            (at / f"traj_{traj}_FigureC_sep4_mom{P.written(a)}_mom{P.written(b)}").write_text(lines)
    (at / "notes.txt").write_text("no measurement")
    (at / "traj_10_FigureC_sep4_mom99_momx").write_text("0 0 nonsense")
    return str(at), value


def test_only_needed_files_are_opened(spark, folder):
    path, value = folder
    there = P.catalogue(spark, path, SHORT)
    assert there.count() == 8 and {tuple(r["p2src"]) for r in there.where("p1src = array(1, 1, 1)").collect()} == {(-1, -1, -1)}
    weights = P.needed([((1, 1, 1), (1, 1, 1), 0.5), ((-1, 1, 1), (1, 1, 1), 2.0), ((1, 1, 1), (9, 9, 9), 0.0)], spark)
    files = P.chosen(there, weights)
    rows = files.collect()
    assert len(rows) == 4 and not any(r["substituted"] for r in rows)
    values = P.measured(files)
    assert values.inputFiles() is not None and {f.rsplit("/", 1)[1] for f in values.inputFiles() if "/figures" in f} == {r["path"].rsplit("/", 1)[1] for r in rows}
    got = {(r["traj"], r["tsrc"], r["t"]): (r["re"], r["im"]) for r in P.projected(values, weights).collect()}
    for traj in (10, 20):
        want = 0.5 * (value(traj, (1, 1, 1), (1, 1, 1)) + 2) + 2.0 * (value(traj, (-1, 1, 1), (1, 1, 1)) + 2)
        assert got[traj, 1, 2] == (pytest.approx(want), pytest.approx(-2.5 * 2.5))


def test_equivalent_files_stand_in(spark, folder):
    path, _ = folder
    there = P.catalogue(spark, path, SHORT)
    wanted = [((1, 1, 1), (1, 1, 1)), ((-1, -1, -1), (-1, -1, -1)), ((1, 1, -1), (1, 1, 1)), ((-1, -1, -1), (-1, -1, 1)), ((-1, -1, -1), (-1, 1, -1)), ((2, 0, 0), (0, 0, 2))]
    frame = P.needed([(a, b, 1.0) for a, b in wanted], spark)
    found = {}
    for r in P.chosen(there, frame).where("traj = 10 OR traj IS NULL").collect():
        found[tuple(r["p1src"]), tuple(r["p1snk"])] = (r["path"] and r["path"].rsplit("sep4_", 1)[1], r["substituted"])
    assert found[wanted[0]] == ("mom111_mom111", False)
    assert found[wanted[1]] == ("mom111_mom111", True)  # parity
    assert found[wanted[2]][1] and found[wanted[2]][0] in ("mom_111_mom111", "mom1_11_mom111")  # other axes
    # Source and sink exchanged with opposite momenta: (1,1,-1) to (1,1,1), then axes.
    assert found[wanted[3]][1] and found[wanted[4]] == ("mom1_11_mom111", True)
    assert found[wanted[5]] == (None, None)
    only = {(tuple(r["p1src"]), tuple(r["p1snk"])): r["path"] for r in P.chosen(there, frame, ["parity"]).where("traj = 10 OR traj IS NULL").collect()}
    assert sum(p is not None for p in only.values()) == 2
    with pytest.raises(ValueError, match="no file, nor an equivalent one"):
        P.measured(P.chosen(there, frame))
    with pytest.raises(ValueError, match="symmetries are"):
        P.chosen(there, frame, ["colour"])
    with pytest.raises(ValueError, match="no momenta"):
        P.measured(P.chosen(there, frame.where("false")))
    # One file for several momenta.
    some = P.chosen(there, frame.where("p1src[0] = p1src[1] AND p1src[1] = p1src[2] AND p1snk[0] = p1snk[1] AND p1snk[1] = p1snk[2]"))
    assert P.measured(some).where("traj = 10").groupBy("p1src").count().count() == 2


def test_a_total_momentum(spark, tmp_path):
    total = (2, 0, 0)
    for p1, p2 in (((1, 1, 1), (1, -1, -1)), ((1, 1, 1), (-1, -1, -1))):
        (tmp_path / TEMPLATE.replace("<TRAJ>", "7").replace("<FIG>", "R").replace("<TSEP>", "4").replace("<P1SRC>", P.written(p1)).replace("<P2SRC>", P.written(p2)).replace("<P1SNK>", P.written(opposite(p1))).replace("<P2SNK>", P.written(opposite(p2)))).write_text("0 0 1 0\n")
    assert P.catalogue(spark, str(tmp_path), TEMPLATE, total).count() == 1 and P.catalogue(spark, str(tmp_path), TEMPLATE).count() == 1
