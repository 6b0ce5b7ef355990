"""P-values of fits by resampling the raw samples and fitting again.

Each boot of the raw samples gives means, and a covariance matrix of its own, in
one aggregation over (boot, pair of points). The boots are moved so that the
central fit is true, fitted again, and the central chi-square takes its place
among theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import special
from samplewright.workers import on_workers

from .fits import Function, Options, degrees, fit
from .series import p_value
from .weights import boot_triangles, of_covariance, square


def _moments(rows, points: list) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariance matrix of one boot."""
    place = {t: k for k, t in enumerate(points)}
    means = np.full(len(points), np.nan)
    for r in rows:
        if r["t_i"] == r["t_j"] and r["mean"] is not None:
            means[place[r["t_i"]]] = r["mean"]
    return means, square([(place[r["t_i"]], place[r["t_j"]], r["covariance"]) for r in rows], len(points))


def resampled_q2(
    raw: DataFrame, table: DataFrame, function: Function, low: float, high: float, strategy: str = "frozen", size: int = 1, options: Options = Options(), cutoff: float | None = None, recentred: bool = True
) -> DataFrame:
    """(s, parameters by name, chi2, dof, converged): fits of all boots of raw (t, s, v), moved to where the central fit is true, and the central fit as s = -1.

    table (b, pos, s) draws the boots; each is binned by size, its covariance matrix
    follows the strategy (see weights.boot_triangles). Not recentred, the boots are
    those of the data.
    """
    on_workers(raw.sparkSession)
    raw = raw.where(F.col("t").between(low, high))
    triangles = boot_triangles(raw, table, strategy, size)
    kind = "uncorrelated" if strategy == "uncorrelated" else "correlated"
    # Only the raw samples themselves, as many numbers as the fit range squared.
    centre = boot_triangles(raw, table.limit(0), strategy, size).collect()
    points = sorted({r["t_i"] for r in centre})
    x = np.array(points, float)
    means, matrix = _moments(centre, points)
    first, _, good = fit(function, x, means[None, :], of_covariance(matrix, kind, cutoff), options) if points else (np.zeros((0, 0)), None, [False])
    guess = first[0] if good[0] else None
    moved = function.value(x, first)[0] - means if points and recentred else np.zeros(len(points))
    entries = F.collect_list(F.struct("t_i", "t_j", "covariance", "mean")).alias("_c")
    rows = triangles.groupBy(F.col("b").cast("long").alias("s")).agg(entries).where(F.size("_c") == len(points) * (len(points) + 1) // 2)
    schema = ", ".join(["s long", *(f"{n} double" for n in function.names), "chi2 double, dof int, converged boolean"])
    dof = degrees(function, len(points), options)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            found = [_moments(c, points) for c in batch["_c"]]
            y = np.stack([m for m, _ in found]) + np.where(batch["s"].to_numpy()[:, None] >= 0, moved, 0.0)
            w = np.stack([of_covariance(c, kind, cutoff) for _, c in found])
            p, chi2, good = fit(function, x, y, w, options, guess)
            yield pd.DataFrame(p, columns=list(function.names)).assign(s=batch["s"].to_numpy(), chi2=chi2, dof=dof, converged=good)[["s", *function.names, "chi2", "dof", "converged"]]

    return rows.mapInPandas(of, schema)


def central(raw: DataFrame, function: Function, low: float, high: float, strategy: str = "frozen", size: int = 1, options: Options = Options(), cutoff: float | None = None) -> DataFrame:
    """One row (parameters by name, chi2, dof, converged, p, p_t2): the fit to the means of raw samples, weighed as the strategy says for means.

    p is the tail of chi-square, p_t2 that of T-square, which the finite number of
    (binned) samples makes of it.
    """
    none = raw.sparkSession.createDataFrame([], "b long, pos long, s long")
    n = raw.where(F.col("t").between(low, high) & F.col("v").isNotNull()).groupBy("t").agg(F.count("*").alias("n")).agg(F.min(F.floor(F.col("n") / (1 if strategy == "block" else size)) - 1).alias("_n"))
    found = resampled_q2(raw, none, function, low, high, strategy, size, options, cutoff).drop("s").join(F.broadcast(n))  # one row each
    tail = lambda name, *more: special.distribution(name, F.col("chi2"), F.col("dof"), *more)
    return found.select(*function.names, "chi2", "dof", "converged", tail("chi2_p_value").alias("p"), tail("t2_p_value", F.col("_n")).alias("p_t2"))


def placed(q2: DataFrame) -> DataFrame:
    """(p): the share of the boots' chi-squares after the one closest to the central one (s = -1), in order of size."""
    centre = q2.where("s = -1").first()  # one row
    boots = q2.where("s >= 0").select(F.lit(0).alias("t"), F.col("chi2").alias("v"))
    return p_value(boots, float(centre["chi2"])).select("p")
