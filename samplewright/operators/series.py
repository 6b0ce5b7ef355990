"""Operators on series of samples (t, s, v): time algebra, channels, lookups between coordinates.

Series meet by equi-joins on coordinate and sample; windows hold the coordinates
of one sample only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ensembles import permutation
from .resampling import Keys, matched


def _other(df: DataFrame, t) -> DataFrame:
    return df.select(t.cast(df.schema["t"].dataType).alias("t"), "s", F.col("v").alias("_w"))


def reflected(df: DataFrame, period: int) -> DataFrame:
    """Time t becomes (period - t) mod period."""
    return df.withColumn("t", F.pmod(period - F.col("t"), F.lit(period)))


def folded(df: DataFrame, period: int, sign: int = 1, offset: int | None = None) -> DataFrame:
    """Half of C(t) + sign * C(period - t); t = 0 is left as it is, unless an offset shifts the mirror."""
    mirror = _other(df, F.pmod(period - (offset or 0) - F.col("t"), F.lit(period)))
    mean = (F.col("v") + sign * F.col("_w")) / 2
    return df.join(mirror, ["t", "s"]).select("t", "s", (mean if offset is not None else F.when(F.col("t") == 0, F.col("v")).otherwise(mean)).alias("v"))


def less_next(df: DataFrame) -> DataFrame:
    """C(t) - C(t + 1); the last t drops out."""
    return df.join(_other(df, F.col("t") - 1), ["t", "s"]).select("t", "s", (F.col("v") - F.col("_w")).alias("v"))


def less_fixed(df: DataFrame, at: int) -> DataFrame:
    """C(t) - C(at)."""
    fixed = df.where(F.col("t") == at).select("s", F.col("v").alias("_w"))
    return df.join(fixed, "s").select("t", "s", (F.col("v") - F.col("_w")).alias("v"))


def without_samples(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Samples start to stop - 1 go; those after them close the gap."""
    kept = df.where((F.col("s") < start) | (F.col("s") >= stop))
    return kept.withColumn("s", F.when(F.col("s") >= stop, F.col("s") - (stop - start)).otherwise(F.col("s")))


def scrambled(df: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """All series under the same pseudorandom permutation of their n samples."""
    return df.withColumn("s", F.expr(permutation("CAST(s AS BIGINT)", n, seed)))


def numbered(df: DataFrame, keys: Keys, order: str, width: int = 65536) -> DataFrame:
    """df with s: the place of each row within its keys in the order of a whole number, from 0.

    Rows are ranked within ranges of `width` numbers, and ranges begin where the
    sums of those before end, so no task holds a whole series.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(*keys, "_range").orderBy(order)
    ranked = ranged.withColumn("_k", F.row_number().over(within) - 1).join(starts, [*keys, "_range"])
    return ranked.withColumn("s", F.col("_start") + F.col("_k")).drop("_range", "_start", "_k")


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Two channels to one: average, difference, ratio (0 below: null) or sum; coordinates of one channel only are an error."""
    x, y = F.col("v"), F.col("_w")
    value = {"average": (x + y) / 2, "difference": x - y, "ratio": F.try_divide(x, y), "sum": x + y}[how]
    return matched(a, b, ["t", "s"]).select("t", "s", value.alias("v"))


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(t, correlation): correlation coefficient of two quantities over their samples."""
    return a.join(_other(b, F.col("t")), ["t", "s"]).groupBy("t").agg(F.corr("v", "_w").alias("correlation"))


def shifted_product(sink: DataFrame, source: DataFrame, period: int) -> DataFrame:
    """(t, s, v): mean over source times r of sink((r + t) mod period) * source(r)."""
    at = source.select(F.col("t").alias("_r"), "s", F.col("v").alias("_w")).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(period - 1))))
    at = at.withColumn("t", F.pmod(F.col("_r") + F.col("_t"), F.lit(period)).cast(sink.schema["t"].dataType))
    return sink.join(at, ["t", "s"]).groupBy(F.col("_t").alias("t"), "s").agg(F.avg(F.col("v") * F.col("_w")).alias("v"))


def interpolated(df: DataFrame, points: list[float]) -> DataFrame:
    """(t, s, v) at the points: straight lines between neighbours, the outer ones carried on."""
    order = W.partitionBy("s").orderBy("t")
    line = df.withColumns({"_t2": F.lead("t").over(order), "_v2": F.lead("v").over(order), "_before": F.lag("t").over(order)}).where("_t2 IS NOT NULL")
    line = line.withColumn("_after", F.lead("t").over(order)).withColumn("_x", F.explode(F.array(*map(F.lit, points))))
    mine = F.expr("(_x >= t OR _before IS NULL) AND (_x < _t2 OR _after IS NULL)")
    return line.where(mine).select(F.col("_x").alias("t"), "s", F.expr("v + (_v2 - v) * (_x - t) / (_t2 - t)").alias("v"))


def closest(df: DataFrame, target: float, most: int = 2) -> DataFrame:
    """The points of each sample whose value is closest to the target; ties by t."""
    order = W.partitionBy("s").orderBy(F.abs(F.col("v") - target), "t")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def slope(df: DataFrame, target: float) -> DataFrame:
    """(s, slope): through the two points closest to the target."""
    ends = F.max(F.struct("t", "v")).alias("b"), F.min(F.struct("t", "v")).alias("a")
    return closest(df, target).groupBy("s").agg(*ends).select("s", F.expr("try_divide(b.v - a.v, b.t - a.t)").alias("slope"))


def p_value(df: DataFrame, q2: float) -> DataFrame:
    """(t, p): share of sorted values after the one closest to q2; of equally close ones the first counts.

    Values are counted by distance and side in one pass, not compared with a closest one found
    in another: means of the same rows differ in their last bits where parts arrive in another order.
    """
    sides = df.where("t IS NOT NULL").groupBy("t", F.expr(f"abs(v - {q2!r}D)").alias("_d"), F.expr(f"v > {q2!r}D").alias("_above")).agg(F.count("*").alias("_n"))
    near = F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "_above", "_n"))).alias("_near")
    ends = sides.groupBy("t").agg(F.sum("_n").alias("_all"), F.sum(F.expr("IF(NOT _above, _n, 0)")).alias("_below"), near)
    return ends.select("t", F.expr("(_all - (_below - IF(NOT _near._above, _near._n, 0)) - 1) / _all").alias("p"))


def recentred(df: DataFrame, centre: DataFrame) -> DataFrame:
    """Samples moved so that the mean at t is the centre (t, fit)."""
    shift = df.groupBy("t").agg(F.avg("v").alias("_m")).join(centre, "t").select("t", (F.col("fit") - F.col("_m")).alias("_d"))
    return df.join(shift, "t").select("t", "s", (F.col("v") + F.col("_d")).alias("v"))
