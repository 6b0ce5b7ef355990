"""What fits weigh points with: correlations and errors, one matrix for all samples or one for each.

A triangle (t_i, t_j[, s], correlation, sigma_i, sigma_j) is as large as the fit
range squared, times the samples where each has its own. Covariances over inner
samples come in closed form from sums, so no N * N rows arise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ensembles import block_double_jackknife_covariance
from .matrices import normalised, shrunk
from .resampling import binned, boot_covariance, bootstrap, double_jackknife_covariance, jackknife, pairs, present

#: Strategies that take raw samples and give each resampled one a matrix of its own.
BY_SAMPLE = ("correlated", "block", "hybrid")


def correlations(df: DataFrame, strategy: str, size: int = 1, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(resampled samples (t, s, v), triangle with s) of raw samples.

    correlated: jackknife of bins of `size` samples, each with the matrix of its own
    double jackknife; with a resample table, boots, each with the matrix of its own
    jackknife. block: the same jackknife, each with the matrix over all single
    samples outside its bin. hybrid: correlations of block, errors of correlated.
    """
    if strategy not in BY_SAMPLE:
        raise ValueError(f"unknown strategy {strategy}")
    df = present(df)
    if table is not None:
        if strategy != "correlated" or size != 1:
            raise ValueError("boots have the strategy correlated only, of blocks drawn by their table")
        return bootstrap(df, table, ["t"]), normalised(boot_covariance(df, table, "t").withColumnRenamed("b", "s"), keys=["s"])
    bins = binned(df, ["t"], size) if size > 1 else df
    data = jackknife(bins, ["t"])
    own = lambda: normalised(double_jackknife_covariance(bins, "t"), keys=["s"])
    if strategy == "correlated":
        return data, own()
    block = normalised(block_double_jackknife_covariance(df, "t", size).withColumnRenamed("block", "s"), keys=["s"])
    if strategy == "block":
        return data, block
    errors = own().select("t_i", "t_j", "s", "sigma_i", "sigma_j")
    return data, block.drop("sigma_i", "sigma_j").join(errors, ["t_i", "t_j", "s"])


def with_means(df: DataFrame, kind: str) -> DataFrame:
    """(t_i, t_j, covariance, mean) of resampled samples: a triangle of covariances of means, and the mean at t_i."""
    n = F.count("*") - 1
    value = {"raw": F.try_divide(F.covar_pop("x", "y"), n), "jackknife": F.covar_pop("x", "y") * n, "bootstrap": F.covar_pop("x", "y")}[kind]
    return pairs(df, "t").groupBy("t_i", "t_j").agg(value.alias("covariance"), F.avg("x").alias("mean"))


def shrunk_correlations(triangle: DataFrame) -> DataFrame:
    """A triangle with s whose correlations are drawn towards the unit matrix, as far as their own errors say."""
    return shrunk(triangle).select("t_i", "t_j", "s", "correlation").join(triangle.drop("correlation"), ["t_i", "t_j", "s"])


def boot_triangles(df: DataFrame, table: DataFrame, strategy: str, size: int = 1) -> DataFrame:
    """(b, t_i, t_j, covariance, mean): for each boot of raw samples, and for these as b = -1, the covariance of means a central fit has.

    frozen, correlated and uncorrelated: over bins of `size` neighbours in the boot;
    block: over single samples; hybrid: correlations of block, errors of bins. mean
    is that of the bins at t_i.
    """
    df = present(df)
    boots = df.join(table.withColumnRenamed("s", "_from"), F.col("s") == F.col("_from")).select("t", "b", F.col("pos").alias("s"), "v")
    boots = boots.unionByName(df.select("t", F.lit(-1).cast("long").alias("b"), "s", "v"))

    def over(rows: DataFrame) -> DataFrame:
        left = rows.select(F.col("t").alias("t_i"), "b", "s", F.col("v").alias("x"))
        right = rows.select(F.col("t").alias("t_j"), "b", "s", F.col("v").alias("y"))
        both = left.join(right, ["b", "s"]).where("t_i <= t_j")
        return both.groupBy("b", "t_i", "t_j").agg(F.try_divide(F.covar_pop("x", "y"), F.count("*") - 1).alias("covariance"), F.avg("x").alias("mean"))

    bins = over(binned(boots, ["t", "b"], size) if size > 1 else boots)
    if strategy in ("frozen", "correlated", "uncorrelated"):
        return bins
    single = over(boots)
    if strategy == "block":
        return single
    if strategy != "hybrid":
        raise ValueError(f"unknown strategy {strategy}")
    sigma = lambda rows, at, name: rows.where("t_i = t_j").select("b", F.col("t_i").alias(at), F.col("covariance").alias(name))
    for at in ("t_i", "t_j"):
        single = single.join(sigma(bins, at, f"_{at}"), ["b", at]).join(sigma(over(boots), at, f"_own_{at}"), ["b", at])
    ratio = F.sqrt(F.try_divide(F.col("_t_i") * F.col("_t_j"), F.col("_own_t_i") * F.col("_own_t_j")))
    means = bins.select("b", "t_i", "t_j", "mean")
    return single.select("b", "t_i", "t_j", (F.col("covariance") * ratio).alias("covariance")).join(means, ["b", "t_i", "t_j"])


def inverse(matrix: np.ndarray, cutoff: float | None = None) -> tuple[np.ndarray, float, float]:
    """Inverse by singular values, condition number, and size of matrix * inverse - 1.

    With a cutoff, eigenvalues of a symmetric matrix up to it don't count.
    """
    if cutoff is not None:
        values, vectors = np.linalg.eigh(matrix)
        kept = values > cutoff
        out = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
        return out, float(values[kept].max() / values[kept].min()) if kept.any() else np.inf, float(np.linalg.norm(matrix @ out - np.eye(len(matrix))))
    u, sizes, v = np.linalg.svd(matrix)
    out = (v.T / sizes) @ u.T
    return out, float(sizes[0] / sizes[-1]) if sizes[-1] else np.inf, float(np.linalg.norm(matrix @ out - np.eye(len(matrix))))


def modified(correlation: np.ndarray, cutoff: float) -> np.ndarray:
    """A correlation matrix whose eigenvalues up to the cutoff are left out and whose diagonal is set to 1 again."""
    values, vectors = np.linalg.eigh(correlation)
    kept = values > cutoff
    out = (vectors[:, kept] * values[kept]) @ vectors[:, kept].T
    np.fill_diagonal(out, 1.0)
    return out


def weight(correlation: np.ndarray, sigma: np.ndarray, strategy: str = "correlated", cutoff: float | None = None, modify: float | None = None, inverted: bool = False) -> np.ndarray:
    """The inverse covariance a fit uses; nan throughout where the matrix isn't finite.

    correlation is that matrix, or its inverse; of it are left out eigenvalues up to
    cutoff, or with modify those up to it before the inversion (see modified).
    """
    with np.errstate(all="ignore"):
        if strategy == "uncorrelated":
            return np.diag(1 / sigma**2)
        if not np.isfinite(correlation).all():
            return np.full(correlation.shape, np.nan)
        if modify is not None:
            correlation = modified(correlation, modify)
        return (correlation if inverted else inverse(correlation, cutoff)[0]) / np.outer(sigma, sigma)


def of_covariance(matrix: np.ndarray, strategy: str = "correlated", cutoff: float | None = None, modify: float | None = None) -> np.ndarray:
    """The inverse covariance a fit uses, from the covariance matrix."""
    with np.errstate(all="ignore"):
        sigma = np.sqrt(np.diag(matrix))
        return weight(matrix / np.outer(sigma, sigma), sigma, strategy, cutoff, modify)


def square(rows, n: int, empty: float = np.nan) -> np.ndarray:
    """A symmetric matrix from entries (i, j, v) of a triangle."""
    out = np.full((n, n), empty)
    for i, j, v in rows:
        out[i, j] = out[j, i] = np.nan if v is None else v
    return out

