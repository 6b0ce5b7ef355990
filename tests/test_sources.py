"""Files of ensembles, synthetic samples, parameters, regridding, phases."""

import math
import struct

import numpy as np
import pytest

from samplewright.functions import special
from samplewright.operators import eigen as G
from samplewright.operators import resampling as R
from samplewright.sources import ensembles as Z


def test_xml_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(s, 1.5 + s / 7) for s in range(9)], "s long, v double")
    Z.xml_dump(df, str(tmp_path / "x"), "32ID")
    got = Z.xml_ensembles(spark, str(tmp_path / "x")).collect()
    assert {r["ens"] for r in got} == {"32ID"} and len(got) == 10
    assert {r["s"]: r["v"] for r in got if r["s"] >= 0} == {s: 1.5 + s / 7 for s in range(9)}
    assert next(r["v"] for r in got if r["s"] == -1) == pytest.approx(np.mean([1.5 + s / 7 for s in range(9)]))


def test_xml_of_two_ensembles(spark, tmp_path):
    one = "<elem><tag>{0}</tag><SampleType>Jackknife</SampleType><EnsembleSize>{1}</EnsembleSize><avg>{2}</avg><values>{3}</values></elem>"
    whole = "<data_in_file><Nentries>1</Nentries><list>\n<elem>\n<SampleType>SuperJackBoot</SampleType><Nmeas>{0}</Nmeas><Nensembles>2</Nensembles><Ensembles>{1}</Ensembles></elem></list></data_in_file>"
    (tmp_path / "good.xml").write_text(whole.format(5, one.format("a", 2, 1.0, "1 2 ") + one.format("b", 3, 1.0, "3 4\n5")))
    got = {(r["ens"], r["s"]): r["v"] for r in Z.xml_ensembles(spark, str(tmp_path / "good.xml")).collect()}
    assert got == {("a", -1): 1, ("a", 0): 1, ("a", 1): 2, ("b", -1): 1, ("b", 0): 3, ("b", 1): 4, ("b", 2): 5}
    for k, (n, second) in enumerate([(6, one.format("b", 3, 1.0, "3 4 5")), (5, one.format("b", 3, 2.0, "3 4 5")), (5, one.format("b", 3, 1.0, "3 4"))]):
        (tmp_path / f"bad{k}.xml").write_text(whole.format(n, one.format("a", 2, 1.0, "1 2") + second))
        with pytest.raises(Exception, match="not a file of jackknife ensembles"):
            Z.xml_ensembles(spark, str(tmp_path / f"bad{k}.xml")).collect()


def binary(kind=4, sizes=((b"a", 2), (b"b", 3))):
    n = sum(size for _, size in sizes)
    out = struct.pack(">ii", kind, n) + Z.numbers(range(n)) + Z.numbers([9.5]) + struct.pack(">i", len(sizes)) + struct.pack(f">{len(sizes)}i", *[2] * len(sizes)) + struct.pack(">i", len(sizes))
    return out + b"".join(struct.pack(">5i", size, size, size, 1, 2) + tag + b"\n" for tag, size in sizes)


def test_binary_files(spark, tmp_path):
    (tmp_path / "one.dat").write_bytes(binary())
    got = {(r["ens"], r["s"]): r["v"] for r in Z.binary_ensembles(spark, str(tmp_path / "one.dat")).collect()}
    assert got == {("a", -1): 9.5, ("a", 0): 0, ("a", 1): 1, ("b", -1): 9.5, ("b", 0): 2, ("b", 1): 3, ("b", 2): 4}
    with pytest.raises(ValueError, match="sample type 4"):
        Z.unpacked(binary(kind=2))


def test_parameters_keep_their_kind(spark, tmp_path):
    rows = [(s, 1.0 * s, 2.0 * s) for s in range(4)]
    df = spark.createDataFrame(rows, "s long, A double, E double")
    Z.saved_parameters(df, ["A", "E"], str(tmp_path / "p"), "jackknife")
    assert sorted(map(tuple, Z.loaded_parameters(spark, str(tmp_path / "p"), "jackknife", ["A", "E"]).collect())) == rows
    with pytest.raises(ValueError, match="not bootstrap"):
        Z.loaded_parameters(spark, str(tmp_path / "p"), "bootstrap", ["A", "E"])


def test_synthetic_samples(spark):
    got = np.array([[r["t"], r["v"]] for r in Z.synthetic(spark, 2, 20_000, 1.0, 0.5).collect()])
    a, b = (got[got[:, 0] == t, 1] for t in (0, 1))
    for v in (a, b):
        assert abs(v.mean() - 1) < 0.02 and abs(v.std() - 0.5) < 0.02 and abs(((v - 1) ** 4).mean() / 0.0625 - 3) < 0.2
    flat = np.array([r["v"] for r in Z.synthetic(spark, 1, 20_000, kind="uniform").collect()])
    assert 0 < flat.min() < 0.01 and 0.99 < flat.max() < 1 and abs(flat.mean() - 0.5) < 0.01
    jack = Z.synthetic_jackknife(spark, 2, 50, 3.0, 0.2, tolerance=0.1)
    for r in R.jackknife_error(jack, ["t"]).collect():
        assert r["mean"] == pytest.approx(3.0, abs=1e-12) and abs(r["error"] / 0.2 - 1) <= 0.1
    with pytest.raises(ValueError, match="tries"):
        Z.synthetic_jackknife(spark, 1, 5, 3.0, 0.2, tolerance=1e-9, tries=2)


def test_regridding_by_numpy(spark):
    rng = np.random.default_rng(3)
    rows, series = [], {}
    for traj in range(4):
        t = np.sort(rng.choice(np.arange(0, 40) / 8, 9, replace=False))
        v = rng.normal(size=9)
        series[traj] = t, v
        rows += [(traj, float(a), float(b)) for a, b in zip(t, v, strict=True)]
    got = {}
    for r in Z.regridded(spark.createDataFrame(rows, "traj long, t double, v double")).collect():
        got.setdefault(r["traj"], []).append((r["t"], r["v"]))
    low, high = min(t[0] for t, _ in series.values()), max(t[-1] for t, _ in series.values())
    step = min(np.diff(t).min() for t, _ in series.values())
    n = int(np.ceil((high - low) / step - 1e-12))
    for traj, (t, v) in series.items():
        x = low + np.arange(n + 1) * (high - low) / n
        k = np.clip(np.searchsorted(t, x + 1e-9, "right") - 1, 0, 7)
        want = v[k] + (v[k + 1] - v[k]) * (x - t[k]) / (t[k + 1] - t[k])
        assert np.allclose([b for _, b in sorted(got[traj])], want) and np.allclose([a for a, _ in sorted(got[traj])], x)


def zeta_sum(q, twists, split):
    """The same function with the sum and the integral split elsewhere, which must not show."""
    k = np.arange(-9, 10)
    n = np.stack(np.meshgrid(k, k, k, indexing="ij"), -1).reshape(-1, 3).astype(float)
    r2 = ((n + np.array(twists) / 2) ** 2).sum(axis=1)
    out = (np.exp(-split * (r2 - q * q)) / (r2 - q * q)).sum()
    x, w = np.polynomial.legendre.leggauss(300)
    t, w = (x + 1) / 2 * split, w / 2 * split
    for m in n[n.any(axis=1) & ((n * n).sum(axis=1) < 30)]:
        out += (-1) ** int(m @ np.array(twists)) * (np.exp(t * q * q - np.pi**2 * (m @ m) / t) * (np.pi / t) ** 1.5 * w).sum()
    return out + np.pi**1.5 * sum(q ** (2 * j) * split ** (j - 0.5) / math.factorial(j) / (j - 0.5) for j in range(60))


# Published values; those with three twists are good to some 1e-4 only.
@pytest.mark.parametrize(("q", "twists", "phi"), [(0.1, (0, 0, 1), 0.790456), (0.3, (1, 1, 1), 1.079671), (0.4, (0, 0, 0), 0.571791), (2.0, (1, 1, 1), -1.315088)])
def test_phases(spark, q, twists, phi):
    got = special.zeta_phi(q, twists)[0]
    assert got == pytest.approx(phi, abs=2e-4)
    assert got == pytest.approx(np.arctan(-q * np.pi**1.5 / zeta_sum(q, twists, 0.7) * np.sqrt(4 * np.pi)), abs=1e-8)
    df = spark.createDataFrame([(q,), (None,)], "q double")
    assert [r[0] for r in df.select(special.phase(df["q"], twists)).collect()] == [pytest.approx(got), None]


def test_orthonormal_rows(spark):
    a = np.random.default_rng(1).normal(size=(3, 3))
    df = spark.createDataFrame([(0, i, j, float(a[i, j])) for i in range(3) for j in range(3)] + [(1, 0, 0, 1.0), (1, 0, 1, 2.0)], "s long, i long, j long, v double")
    got = np.zeros((3, 3))
    for r in G.orthonormal(df, ["s"]).collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.allclose(got @ got.T, np.eye(3)) and np.allclose(np.tril(a @ got.T), a @ got.T) and (np.diag(a @ got.T) > 0).all()
    assert {r["s"]: r["v"] for r in G.determinants(df, ["s"]).collect()} == {0: pytest.approx(np.linalg.det(a)), 1: None}


def test_binary_files_of_one_ensemble(spark, tmp_path):
    for kind, name in ((2, "jackknife.dat"), (3, "boots.dat")):
        data = struct.pack(">ii", kind, 3) + Z.numbers([1.5, 2.5, 3.5]) + Z.numbers([2.25])
        (tmp_path / name).write_bytes(data)
        got = {(r["ens"], r["s"]): r["v"] for r in Z.binary_ensembles(spark, str(tmp_path / name)).collect()}
        assert got == {("", -1): 2.25, ("", 0): 1.5, ("", 1): 2.5, ("", 2): 3.5}
        with pytest.raises(ValueError, match="bytes follow"):
            Z.unpacked(data + b"x")
    with pytest.raises(ValueError, match="sample type"):
        Z.unpacked(struct.pack(">ii", 1, 0))
