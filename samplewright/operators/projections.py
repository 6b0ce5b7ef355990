"""Operators that couple to one state: fitted amplitudes inverted by sample, and correlators contracted with them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.workers import on_workers

from .eigen import _square, gathered


def optimal(amplitudes: DataFrame, state: int = 0, scale: float = 1.0) -> DataFrame:
    """(i, s, v): how much of operator i makes up the operator that couples to one state alone.

    amplitudes is (n, i, s, v), of states n and as many operators i, numbered from 0;
    scale is what amplitudes were divided by the root of. Samples whose matrix is
    incomplete or can't be inverted are left out.
    """
    on_workers(amplitudes.sparkSession)

    @F.pandas_udf("array<double>")
    def of(m: pd.Series) -> pd.Series:
        out = []
        for flat in m:
            a = _square(flat)
            good = a is not None and np.isfinite(a).all() and state < len(a) and np.linalg.matrix_rank(a) == len(a)
            out.append(np.linalg.inv(a * scale**0.5)[:, state].tolist() if good else None)
        return pd.Series(out, dtype=object)

    rows = gathered(amplitudes.select(F.col("n").alias("i"), F.col("i").alias("j"), "s", "v"), ["s"]).select("s", of("m").alias("_r"))
    return rows.select("s", F.posexplode("_r").alias("i", "v")).select("i", "s", "v")


def projected(df: DataFrame, weights: DataFrame) -> DataFrame:
    """(t, s, v): sum of C_ij r_i r_j of correlators (t, i, j, s, v) and weights (i, s, v).

    Samples without weights, and sums that lack an entry, are left out.
    """
    n = weights.groupBy("s").agg((F.count("*") * F.count("*")).alias("_n"))
    at = lambda name, value: weights.select(F.col("i").alias(name), "s", F.col("v").alias(value))
    terms = df.join(at("i", "_a"), ["i", "s"]).join(at("j", "_b"), ["j", "s"])
    sums = terms.groupBy("t", "s").agg(F.sum(F.col("v") * F.col("_a") * F.col("_b")).alias("v"), F.count("v").alias("_m"))
    return sums.join(n, "s").where("_m = _n").select("t", "s", "v")
