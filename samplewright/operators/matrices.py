"""Matrices of samples in long form (i, j, s, v), and of numbers (i, j, v): products, norms, bases, correlation matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Ten weak operators in the chiral basis of seven, and back.
SEVEN_FROM_TEN = (
    (3, 2, -1, 0, 0, 0, 0, 0, 0, 0),
    (2 / 5, -2 / 5, 1 / 5, 0, 0, 0, 0, 0, 0, 0),
    (-3 / 5, 3 / 5, 1 / 5, 0, 0, 0, 0, 0, 0, 0),
    (0, 0, 0, 0, 1, 0, 0, 0, 0, 0),
    (0, 0, 0, 0, 0, 1, 0, 0, 0, 0),
    (0, 0, 0, 0, 0, 0, 1, 0, 0, 0),
    (0, 0, 0, 0, 0, 0, 0, 1, 0, 0),
)
TEN_FROM_SEVEN = (
    (1 / 5, 1, 0, 0, 0, 0, 0),
    (1 / 5, 0, 1, 0, 0, 0, 0),
    (0, 3, 2, 0, 0, 0, 0),
    (0, 2, 3, 0, 0, 0, 0),
    (0, 0, 0, 1, 0, 0, 0),
    (0, 0, 0, 0, 1, 0, 0),
    (0, 0, 0, 0, 0, 1, 0),
    (0, 0, 0, 0, 0, 0, 1),
    (3 / 10, 0, -1, 0, 0, 0, 0),
    (3 / 10, -1, 0, 0, 0, 0, 0),
)


def _sample(*dfs: DataFrame) -> list[str]:
    """The sample column, where all of them have one."""
    return ["s"] if all("s" in df.columns for df in dfs) else []


def multiplied(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product, sample by sample; a matrix of numbers counts for every sample."""
    s = _sample(a, b)
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_w"), *(["s"] if "s" in b.columns else []))
    left = a.withColumnRenamed("j", "_k")
    if set(right.columns) & {"s"} and "s" not in a.columns or "s" in a.columns and "s" not in b.columns:
        s = []
    joined = left.join(right, ["_k", *s])
    own = ["s"] if "s" in joined.columns else []
    return joined.groupBy("i", F.col("_j").alias("j"), *own).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def applied_to(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """The matrix times a vector (i, s, v)."""
    out = multiplied(matrix, vector.withColumn("j", F.lit(0)))
    return out.drop("j")


def transposed(df: DataFrame) -> DataFrame:
    return df.withColumns({"i": F.col("j"), "j": F.col("i")})


def submatrix(df: DataFrame, rows: Sequence[int], columns: Sequence[int]) -> DataFrame:
    """The entries in these rows and columns, numbered anew in the order given."""
    place = lambda c, chosen: (F.array_position(F.array(*map(F.lit, chosen)), F.col(c)) - 1).cast("int")
    kept = df.where(F.col("i").isin(*rows) & F.col("j").isin(*columns))
    return kept.withColumns({"i": place("i", rows), "j": place("j", columns)})


def contracted(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s, v): sum over all entries of a_ij * b_ij."""
    s = _sample(a, b)
    other = b.select("i", "j", *s, F.col("v").alias("_w"))
    return a.join(other, ["i", "j", *s]).groupBy(*s).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def norms(df: DataFrame) -> DataFrame:
    """(s, frobenius, one, infinity): root of summed squares, largest column sum, largest row sum of sizes."""
    s = _sample(df)
    squares = df.groupBy(*s).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"))
    largest = lambda c, name: df.groupBy(*s, c).agg(F.sum(F.abs("v")).alias("_n")).groupBy(*s).agg(F.max("_n").alias(name))
    one, infinity = largest("j", "one"), largest("i", "infinity")
    if s:
        return squares.join(one, s).join(infinity, s)
    return squares.join(F.broadcast(one)).join(F.broadcast(infinity))  # one row each


def less_matrix(df: DataFrame, constant: DataFrame) -> DataFrame:
    """df (t, i, j, s, v) less a matrix that doesn't depend on t: of numbers, of samples, or of outer samples for (s, inner)."""
    on = ["i", "j", *_sample(df, constant)]
    return df.join(constant.select(*on, F.col("v").alias("_w")), on).withColumn("v", F.col("v") - F.col("_w")).drop("_w").select(*df.columns)


def in_basis(df: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """(i, t, s, v): operators (j, t, s, v) in another basis, new_i = sum of matrix_ij * old_j; the matrix is a small constant."""
    entries = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(c)).alias("c")) for i, row in enumerate(matrix) for j, c in enumerate(row) if c))
    spread = df.withColumn("_e", F.explode(F.filter(entries, lambda e: e["j"] == F.col("j"))))
    return spread.groupBy("_e.i", "t", "s").agg(F.sum(F.col("_e.c") * F.col("v")).alias("v"))


def normalised(covariance: DataFrame, key: str = "t", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, key_i, key_j, correlation, sigma_i, sigma_j) from a triangle of covariances; null where a sigma is 0."""
    i, j = f"{key}_i", f"{key}_j"
    own = covariance.where(F.col(i) == F.col(j))
    sigma = lambda at, name: own.select(*keys, F.col(i).alias(at), F.sqrt("covariance").alias(name))
    both = covariance.join(sigma(i, "sigma_i"), [*keys, i]).join(sigma(j, "sigma_j"), [*keys, j])
    return both.select(*keys, i, j, F.try_divide("covariance", F.col("sigma_i") * F.col("sigma_j")).alias("correlation"), "sigma_i", "sigma_j")


def dumped(correlation: DataFrame, key: str = "t", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, key_i, key_j, covariance): the covariance matrix of a correlation matrix and its sigmas, both triangles."""
    i, j = f"{key}_i", f"{key}_j"
    value = (F.col("correlation") * F.col("sigma_i") * F.col("sigma_j")).alias("covariance")
    upper = correlation.select(*keys, i, j, value)
    return upper.unionByName(upper.where(F.col(i) != F.col(j)).withColumns({i: F.col(j), j: F.col(i)}))


def shrunk(correlation: DataFrame, key: str = "t") -> DataFrame:
    """(key_i, key_j, s, correlation, shrinkage): jackknife samples of a correlation matrix drawn towards the unit matrix.

    The share is the summed squared errors of the entries off the diagonal over
    the summed mean squares of all entries; both triangles count. correlation is
    a triangle (key_i, key_j, s, correlation).
    """
    i, j = f"{key}_i", f"{key}_j"
    off = F.col(i) != F.col(j)
    entries = correlation.groupBy(i, j).agg(((F.count("*") - 1) * F.var_pop("correlation")).alias("_e"), F.avg(F.col("correlation") * F.col("correlation")).alias("_c"))
    share = entries.agg(F.try_divide(F.sum(F.when(off, 2 * F.col("_e")).otherwise(0.0)), F.sum(F.when(off, 2 * F.col("_c")).otherwise(F.col("_c")))).alias("shrinkage"))
    out = correlation.join(F.broadcast(share))  # one row
    value = (1 - F.col("shrinkage")) * F.col("correlation") + F.when(off, 0.0).otherwise(F.col("shrinkage"))
    return out.select(i, j, "s", value.alias("correlation"), "shrinkage")
