"""Eigenvalues of matrices of samples, and generalised eigenvalue analysis of correlators of matrices.

A matrix (i, j, v) of few operators at one sample is gathered into one row, so a
group is as large as the matrix, never as the table; numpy then solves a batch of
rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.workers import on_workers

from . import roots
from .resampling import Keys, jackknife_error

#: Largest residual |A v - lambda B v| that passes without a warning.
RESIDUAL = 1e-3


def gathered(df: DataFrame, keys: Keys, name: str = "m") -> DataFrame:
    """(keys, name): each matrix as one array, row by row; entries (i, j) run from 0. Incomplete matrices have a wrong length."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "v"))), lambda e: e["v"]).alias(name))


def _square(flat: np.ndarray) -> np.ndarray | None:
    n = round(len(flat) ** 0.5)
    ok = n * n == len(flat) and n > 0 and not any(x is None for x in flat)
    return np.array(flat, float).reshape(n, n) if ok else None


def solve(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Eigenvalues from large to small, vectors as rows (largest component positive), residual.

    Symmetric without b or with a positive definite b; None where b isn't, or
    where an entry isn't finite.
    """
    if not np.isfinite(a).all() or b is not None and not np.isfinite(b).all():
        return None
    try:
        if b is None:
            values, vectors = np.linalg.eigh((a + a.T) / 2)
        else:
            low = np.linalg.inv(np.linalg.cholesky((b + b.T) / 2))
            values, inner = np.linalg.eigh(low @ ((a + a.T) / 2) @ low.T)
            vectors = low.T @ inner
    except np.linalg.LinAlgError:
        return None
    order = np.argsort(-values)
    values, vectors = values[order], vectors.T[order]
    big = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), big])[:, None]
    other = vectors if b is None else vectors @ b.T
    return values, vectors, float(np.abs(vectors @ a.T - values[:, None] * other).max())


def solve_general(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Eigenvalues of a v = lambda b v for any b that can be inverted, vectors as rows, residual; all may be complex.

    Values go by size from large to small, of a complex pair the one with positive
    imaginary part first. Vectors have length 1, their largest component positive.
    """
    if not np.isfinite(a).all() or b is not None and not np.isfinite(b).all():
        return None
    try:
        values, vectors = np.linalg.eig(a if b is None else np.linalg.solve(b, a))
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(values).all():
        return None
    order = np.lexsort((-values.imag, -np.abs(values)))
    values, vectors = values[order].astype(complex), vectors.T[order].astype(complex)
    big = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None] * (np.abs(big) / np.where(big == 0, 1, big))[:, None]
    other = vectors if b is None else vectors @ b.T
    return values, vectors, float(np.abs(vectors @ a.T - values[:, None] * other).max())


def _solved(rows: DataFrame, keys: Keys, general: bool) -> DataFrame:
    """rows (keys, m[, b]) to (keys, n, value, imaginary, vector, residual); no rows where there is no solution.

    In general a vector's components are complex: (re, im).
    """
    on_workers(rows.sparkSession)
    kind = "array<struct<re: double, im: double>>" if general else "array<double>"
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), f"n int, value double, imaginary double, vector {kind}, residual double"])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                a, b = _square(row.m), _square(row.b) if "b" in batch else None
                if a is None or "b" in batch and (b is None or b.shape != a.shape):
                    continue
                own = [getattr(row, k) for k in keys]
                if found := (solve_general if general else solve)(a, b):
                    for n, (x, v) in enumerate(zip(found[0], found[1], strict=True)):
                        parts = [{"re": c.real, "im": c.imag} for c in v.tolist()] if general else v.tolist()
                        out.append((*own, n, float(x.real), float(x.imag), parts, found[2]))
            yield pd.DataFrame(out, columns=[*keys, "n", "value", "imaginary", "vector", "residual"])

    return rows.select(*keys, *(c for c in ("m", "b") if c in rows.columns)).mapInPandas(of, schema)


def eigenvalues(df: DataFrame, keys: Keys, general: bool = False) -> DataFrame:
    """(keys, n, value, imaginary, vector, residual): symmetric or, in general, any matrices' eigenvalues, from large to small."""
    return _solved(gathered(df, keys), keys, general)


def sweep(df: DataFrame, first: int, last: int, latest: int, general: bool = False) -> DataFrame:
    """(t0, t, s, n, value, ...): eigenvalues of C(t) v = lambda C(t0) v for t0 from first to last and t0 < t <= latest.

    df is (t, i, j, s, v). A pair (t0, t) where any sample has no solution drops
    out whole.
    """
    rows = gathered(df.where(F.col("t").between(first, latest)), ["t", "s"])
    base = rows.where(F.col("t") <= last).select(F.col("t").alias("t0"), "s", F.col("m").alias("b"))
    pairs = rows.join(base, "s").where("t > t0").select("t0", "t", "s", "m", "b")
    found = _solved(pairs, ["t0", "t", "s"], general)
    all_ = pairs.groupBy("t0", "t").agg(F.count("*").alias("_n"))
    whole = found.where("n = 0").groupBy("t0", "t").agg(F.count("*").alias("_m")).join(all_, ["t0", "t"]).where("_m = _n").select("t0", "t")
    return found.join(F.broadcast(whole), ["t0", "t"], "left_semi")


def effective_energies(values: DataFrame) -> DataFrame:
    """(t0, t, s, n, v): log of an eigenvalue at t over that at t + 1; null where the ratio isn't positive."""
    following = values.select("t0", (F.col("t") - 1).alias("t"), "s", "n", F.col("value").alias("_w"))
    ratio = F.try_divide("value", "_w")
    return values.join(following, ["t0", "t", "s", "n"]).select("t0", "t", "s", "n", F.when(ratio > 0, F.log(ratio)).alias("v"))


def late_energies(energies: DataFrame, low: int, high: int) -> DataFrame:
    """Energies with t0 >= t / 2 (whole division) and t within a range, without what has no value at any sample."""
    late = energies.where((F.col("t0") >= F.floor(F.col("t") / 2)) & F.col("t").between(low, high))
    whole = late.groupBy("t0", "t", "n").agg(F.bool_and(F.col("v").isNotNull()).alias("_ok")).where("_ok").select("t0", "t", "n")
    return late.join(whole, ["t0", "t", "n"], "left_semi")


def constant_energies(energies: DataFrame) -> DataFrame:
    """(n, s, v): the constant that fits all energies of a state, weighted by their jackknife errors."""
    weights = jackknife_error(energies, ["t0", "t", "n"]).select("t0", "t", "n", F.try_divide(F.lit(1.0), F.col("error") * F.col("error")).alias("_w"))
    return energies.join(weights, ["t0", "t", "n"]).groupBy("n", "s").agg(F.try_divide(F.sum(F.col("_w") * F.col("v")), F.sum("_w")).alias("v"))


def poor_residuals(values: DataFrame, most: float = RESIDUAL) -> DataFrame:
    """(t0, t, residual): pairs where any sample's residual is above the bound."""
    return values.groupBy("t0", "t").agg(F.max("residual").alias("residual")).where(F.col("residual") > most)


def amplitudes(df: DataFrame, values: DataFrame) -> DataFrame:
    """(t0, t, s, n, i, v): effective amplitudes of operator i for state n; null where a root or logarithm has no value.

    With the vectors v and energies E at (t0, t): the inverse of the matrix of
    vectors, times exp(E t), over R = lambda(t0, t0 + t div 2) / lambda(t0, t0 + t)
    / sqrt(v C(t) v), which for odd t is divided by sqrt(exp(E)) as well. Needs t0,
    t, t0 + t div 2 and t0 + t in values.
    """
    on_workers(df.sparkSession)
    energies = effective_energies(values)
    at = lambda name: values.select("t0", F.col("t").alias("_at"), "s", "n", F.col("value").alias(name))
    both = values.join(energies, ["t0", "t", "s", "n"]).withColumn("_at", (F.col("t0") + F.floor(F.col("t") / 2)).cast(values.schema["t"].dataType)).join(at("_half"), ["t0", "_at", "s", "n"])
    both = both.withColumn("_at", F.col("t0") + F.col("t")).join(at("_whole"), ["t0", "_at", "s", "n"])
    states = both.groupBy("t0", "t", "s").agg(F.array_sort(F.collect_list(F.struct("n", "vector", F.col("v").alias("e"), "_half", "_whole"))).alias("x"))
    states = states.select("t0", "t", "s", *(F.expr(f"transform(x, e -> e.{c})").alias(c) for c in ("n", "vector", "e", "_half", "_whole")))

    @F.pandas_udf("array<array<double>>")
    def of(m: pd.Series, vectors: pd.Series, e: pd.Series, half: pd.Series, whole: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for flat, rows, *numbers, time in zip(m, vectors, e, half, whole, t, strict=True):
            c, v = _square(flat), np.stack([np.array(r, float) for r in rows])
            energy, a, b = (np.array(x, float) for x in numbers)
            with np.errstate(all="ignore"):
                r = a / b / np.sqrt(np.einsum("ni,ij,nj->n", v, c, v)) / np.where(time % 2 == 1, np.sqrt(np.exp(energy)), 1.0)
                found = np.linalg.pinv(v).T * (np.exp(energy * time) / r)[:, None] if v.shape[0] == v.shape[1] else np.full(v.shape, np.nan)
            out.append([[x if np.isfinite(x) else None for x in row] for row in found.tolist()])
        return pd.Series(out, dtype=object)

    found = states.join(gathered(df, ["t", "s"]), ["t", "s"])
    found = found.select("t0", "t", "s", "n", of("m", "vector", "e", "_half", "_whole", "t").alias("_a"))
    per_state = found.select("t0", "t", "s", F.explode(F.arrays_zip("n", "_a")).alias("_z")).select("t0", "t", "s", "_z.n", "_z._a")
    return per_state.select("t0", "t", "s", "n", F.posexplode("_a").alias("i", "v"))


def ranked(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, n, value): values from large to small."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"))) - 1)


def determinants(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, v): determinant of each matrix; null for an incomplete one."""
    on_workers(df.sparkSession)

    @F.pandas_udf("double")
    def of(m: pd.Series) -> pd.Series:
        squares = [_square(flat) for flat in m]
        return pd.Series([None if a is None else float(np.linalg.det(a)) for a in squares], dtype="float64")

    return gathered(df, keys).select(*keys, of("m").alias("v"))


def orthonormal(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, i, j, v): the rows of each matrix, made orthonormal one after another (Gram and Schmidt)."""
    on_workers(df.sparkSession)

    @F.pandas_udf("array<array<double>>")
    def of(m: pd.Series) -> pd.Series:
        out = []
        for flat in m:
            if (a := _square(flat)) is None:
                out.append([])
                continue
            q, r = np.linalg.qr(a.T)
            out.append((q * np.sign(np.diag(r))).T.tolist())
        return pd.Series(out, dtype=object)

    rows = gathered(df, keys).select(*keys, F.posexplode(of("m")).alias("i", "_r"))
    return rows.select(*keys, "i", F.posexplode("_r").alias("j", "v"))


def less_next(df: DataFrame) -> DataFrame:
    """Matrices (t, i, j, s, v) less those at t + 1, which takes constants out; the last t drops out."""
    following = df.select((F.col("t") - 1).alias("t"), "i", "j", "s", F.col("v").alias("_w"))
    return df.join(following, ["t", "i", "j", "s"]).select("t", "i", "j", "s", (F.col("v") - F.col("_w")).alias("v"))


def less_time(df: DataFrame, subtracted: int) -> DataFrame:
    """Matrices (t, i, j, s, v) less those at one time, which itself drops out."""
    constant = df.where(F.col("t") == subtracted).select("i", "j", "s", F.col("v").alias("_w"))
    rest = df.where(F.col("t") != subtracted).join(constant, ["i", "j", "s"])
    return rest.select("t", "i", "j", "s", (F.col("v") - F.col("_w")).alias("v"))


def subtracted_energies(values: DataFrame, subtracted: int, guess: float = 0.3, tolerance: float = 1e-4) -> DataFrame:
    """(t0, t, s, n, v): energies of eigenvalues of matrices less those at one time (see less_time).

    The E with (exp(-E t) - exp(-E tsub)) / (exp(-E t0) - exp(-E tsub)) equal to the
    eigenvalue, up to a share of it; null where none is found.
    """

    def equations(x: np.ndarray, given: np.ndarray) -> np.ndarray:
        e, (value, t0, t) = x[:, 0], given.T
        # Both differences over exp(-E t0), so that large E don't end at 0 / 0.
        low = np.expm1(-e * (t - t0)) - np.expm1(-e * (subtracted - t0))
        return ((low / -np.expm1(-e * (subtracted - t0)) - value) / value)[:, None]

    fair = values.where((F.col("t0") != subtracted) & (F.col("t") != subtracted)).select("t0", "t", "s", "n", "value")
    found = roots.solved(fair, equations, ["value", "t0", "t"], {"v": guess}, tolerance)
    return found.select("t0", "t", "s", "n", "v")


def energies_by_distance(energies: DataFrame) -> DataFrame:
    """(d, n, s, v): the constant that fits the energies of a state at one distance t - t0, weighted by their jackknife errors."""
    weights = jackknife_error(energies, ["t0", "t", "n"]).select("t0", "t", "n", F.try_divide(F.lit(1.0), F.col("error") * F.col("error")).alias("_w"))
    rows = energies.join(weights, ["t0", "t", "n"]).withColumn("d", F.col("t") - F.col("t0"))
    return rows.groupBy("d", "n", "s").agg(F.try_divide(F.sum(F.col("_w") * F.col("v")), F.sum("_w")).alias("v"))


def decay_fit(values: DataFrame, t0: int, n: int, low: float, high: float) -> DataFrame:
    """(s, A, E, chi2, dof, converged): exp(-E (t - t0)) fitted to a state's eigenvalues at low <= t - t0 <= high; A is frozen to 1."""
    from .fits import Options, exponential, fitted

    series = values.where((F.col("t0") == t0) & (F.col("n") == n)).select((F.col("t") - t0).alias("t"), "s", F.col("value").alias("v"))
    return fitted(series, exponential(), low, high, "uncorrelated", Options(frozen={"A": 1.0}))
