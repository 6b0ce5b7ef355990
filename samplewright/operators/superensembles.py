"""Quantities on several independent ensembles side by side.

A super-ensemble has outer samples o from 0 to n - 1. A quantity measured on
some of them is resampled there and stands at its mean elsewhere. `members`
(o, s) says which of its samples s an outer sample holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resampling import Keys, matched, present


def contiguous(spark, start: int, n: int) -> DataFrame:
    """members of a quantity whose samples 0 to n - 1 are the outer ones from start on."""
    return spark.range(n).select((F.col("id") + start).alias("o"), F.col("id").alias("s"))


def chosen(outer: DataFrame, condition) -> DataFrame:
    """members from a table of outer samples (o, ...): those that meet a condition, numbered in their order.

    The places come from one row each, so the table should be of samples only.
    """
    from pyspark.sql import Window as W

    return outer.where(condition).select("o", (F.row_number().over(W.orderBy("o")) - 1).cast("long").alias("s"))


def mapped(data_map: DataFrame, tag: str) -> DataFrame:
    """members from a map (outer, inner, tag, place): of several measurements of a tag at one outer sample the first place counts."""
    own = data_map.where(F.col("tag") == tag).groupBy(F.col("outer").alias("o")).agg(F.min_by("inner", "place").alias("s"))
    return own.select("o", "s")


def _placed(df: DataFrame, members: DataFrame, keys: Keys) -> DataFrame:
    return present(df).join(F.broadcast(members), "s").select(*keys, "o", "v")


def _sums(placed: DataFrame, keys: Keys) -> DataFrame:
    return placed.groupBy(*keys).agg(F.sum("v").alias("_sum"), F.count("*").alias("_n"))


def super_jackknife(df: DataFrame, members: DataFrame, n: int, keys: Keys) -> DataFrame:
    """(keys, s, v) on n outer samples: a jackknife where the outer sample is a member, the mean elsewhere."""
    own = _placed(df, members, keys)
    slots = _sums(own, keys).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    value = F.expr("IF(v IS NULL, try_divide(_sum, _n), try_divide(_sum - v, _n - 1))")
    return slots.join(own, [*keys, "o"], "left").select(*keys, F.col("o").alias("s"), value.alias("v"))


def super_double_jackknife(df: DataFrame, members: DataFrame, n: int, keys: Keys) -> DataFrame:
    """(keys, s, inner, v): the double form; both outer samples, one or none of them may be members. N * N rows, so bin first."""
    own = _placed(df, members, keys)
    span = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    slots = _sums(own, keys).withColumn("o", span()).withColumn("inner", span()).where("o <> inner")
    both = slots.join(own.withColumnRenamed("v", "_a"), [*keys, "o"], "left").join(own.select(*keys, F.col("o").alias("inner"), F.col("v").alias("_b")), [*keys, "inner"], "left")
    gone = "(CASE WHEN _a IS NULL THEN 0 ELSE 1 END + CASE WHEN _b IS NULL THEN 0 ELSE 1 END)"
    value = F.expr(f"try_divide(_sum - coalesce(_a, 0) - coalesce(_b, 0), _n - {gone})")
    return both.select(*keys, F.col("o").alias("s"), "inner", value.alias("v"))


def boosted(df: DataFrame, keys: Keys, start: int, n: int) -> DataFrame:
    """(keys, s, v): jackknife samples at the outer samples from start on, their mean on the others of n."""
    means = present(df).groupBy(*keys).agg(F.avg("v").alias("_m"))
    slots = means.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    own = present(df).select(*keys, (F.col("s") + start).cast("long").alias("s"), "v")
    return slots.join(own, [*keys, "s"], "left").select(*keys, "s", F.coalesce("v", "_m").alias("v"))


def boosted_double(df: DataFrame, keys: Keys, start: int, m: int, n: int) -> DataFrame:
    """(keys, s, inner, v): a double jackknife (keys, s, inner, v) of m samples at the outer ones from start on.

    Where only one of both outer samples is a member the inner mean at that one
    stands, where none is the mean of all.
    """
    single = df.groupBy(*keys, "s").agg(F.avg("v").alias("_one")).select(*keys, (F.col("s") + start).cast("long").alias("_s"), "_one")
    means = df.groupBy(*keys).agg(F.avg("v").alias("_m"))
    span = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    slots = means.withColumn("s", span()).withColumn("inner", span()).where("s <> inner")
    within = lambda c: F.col(c).between(start, start + m - 1)
    slots = slots.withColumn("_s", F.when(within("s") & ~within("inner"), F.col("s")).when(within("inner") & ~within("s"), F.col("inner")))
    own = df.select(*keys, (F.col("s") + start).cast("long").alias("s"), (F.col("inner") + start).cast("long").alias("inner"), "v")
    out = slots.join(own, [*keys, "s", "inner"], "left").join(single, [*keys, "_s"], "left")
    return out.select(*keys, "s", "inner", F.coalesce("v", "_one", "_m").alias("v"))


def supermulti_covariance(df: DataFrame, key: str, ensemble: str = "ens", kind: str = "kind") -> DataFrame:
    """(key_i, key_j, covariance): sum over independent ensembles of jackknife (J) or bootstrap (B) covariances, each by its own formula."""
    on = [ensemble, kind, "s"]
    rows = present(df)
    left = rows.select(F.col(key).alias(f"{key}_i"), *on, F.col("v").alias("x"))
    right = rows.select(F.col(key).alias(f"{key}_j"), *on, F.col("v").alias("y"))
    pairs = left.join(right, on).where(F.col(f"{key}_i") <= F.col(f"{key}_j"))
    own = F.covar_pop("x", "y") * F.when(F.col(kind) == "J", F.count("*") - 1).otherwise(1)
    each = pairs.groupBy(f"{key}_i", f"{key}_j", ensemble, kind).agg(own.alias("_c"))
    return each.groupBy(f"{key}_i", f"{key}_j").agg(F.sum("_c").alias("covariance"))


def super_correlation(a: DataFrame, b: DataFrame, keys: Keys, ensemble: str = "ens") -> DataFrame:
    """(keys, ens, correlation): correlation of two quantities on each of their common ensembles."""
    return matched(a, b, [*keys, ensemble, "s"]).groupBy(*keys, ensemble).agg(F.corr("v", "_w").alias("correlation"))
