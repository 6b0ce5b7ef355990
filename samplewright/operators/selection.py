"""Choosing, counting and joining samples, points and ensembles: filters, set operations, layouts, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .resampling import Keys, jackknife_error, matched, present, weighted_average


def in_x_range(df: DataFrame, low: float, high: float, x: str = "t", invert: bool = False) -> DataFrame:
    """Points with low <= x <= high, or the others."""
    inside = F.col(x).between(low, high)
    return df.where(~inside if invert else inside)


def by_position(df: DataFrame, first: int, last: int) -> DataFrame:
    """The points at places first to last (from 0) in the order of t, whatever their t is; places come from the distinct t, one row each."""
    place = F.row_number().over(W.orderBy("t")) - 1
    wanted = df.select("t").distinct().select("t", place.alias("_k")).where(F.col("_k").between(first, last)).select("t")
    return df.join(F.broadcast(wanted), "t", "left_semi")


def at_times(df: DataFrame, which: str, above: int = 0) -> DataFrame:
    """Points at even or odd times, or at times greater than `above`."""
    return df.where({"even": F.col("t") % 2 == 0, "odd": F.pmod("t", F.lit(2)) == 1, "greater": F.col("t") > above}[which])


def with_relative_error(df: DataFrame, most: float, keys: Keys = ("t",)) -> DataFrame:
    """Jackknife series whose error is at most so many times their mean's size; a zero mean fails."""
    good = jackknife_error(df, keys).where(F.try_divide("error", F.abs("mean")) <= most).select(*keys)
    return df.join(good, list(keys), "left_semi")


def without_points(df: DataFrame, points: DataFrame, keys: Keys = ("t",)) -> DataFrame:
    """df without the points listed."""
    return df.join(points.select(*keys).distinct(), list(keys), "left_anti")


def missing_samples(df: DataFrame, n: int, keys: Keys = ("t",)) -> DataFrame:
    """(keys, s): which of the samples 0 to n - 1 a series lacks."""
    wanted = df.select(*keys).distinct().withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return wanted.join(present(df).select(*keys, F.col("s").cast("long").alias("s")), [*keys, "s"], "left_anti")


def reversed_points(df: DataFrame) -> DataFrame:
    """The values in opposite order of t."""
    places = df.select("t").distinct().select("t", F.row_number().over(W.orderBy("t")).alias("_k"), F.row_number().over(W.orderBy(F.desc("t"))).alias("_r"))
    turned = places.select("t", "_k").join(places.select(F.col("t").alias("_t"), F.col("_r").alias("_k")), "_k").select("t", "_t")
    return df.join(F.broadcast(turned), "t").select(F.col("_t").alias("t"), *(c for c in df.columns if c != "t"))


def appended(a: DataFrame, b: DataFrame) -> DataFrame:
    """The series of b after those of a, numbered on: (t, s, v)."""
    most = a.agg((F.coalesce(F.max("t"), F.lit(-1)) + 1).cast(a.schema["t"].dataType).alias("_n"))
    low = b.agg(F.min("t").alias("_low"))
    moved = b.join(F.broadcast(most.join(low)))  # one row
    return a.select("t", "s", "v").unionByName(moved.select((F.col("t") - F.col("_low") + F.col("_n")).cast(a.schema["t"].dataType).alias("t"), "s", "v"))


def sets(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Union, intersection or complement (a without b) of two sets of rows."""
    return {"union": lambda: a.unionByName(b).distinct(), "intersection": lambda: a.intersect(b), "complement": lambda: a.subtract(b)}[how]()


def lacking(layout: DataFrame, of: DataFrame) -> DataFrame:
    """(tag, size) of the ensembles that layout should have and doesn't; none: it holds the other layout."""
    return of.select("tag", "size").subtract(layout.select("tag", "size"))


def remapped(df: DataFrame, tags: DataFrame) -> DataFrame:
    """df with the ensembles' tags replaced by a table (tag, new_tag); tags that aren't in it stay."""
    return df.join(F.broadcast(tags), "tag", "left").withColumn("tag", F.coalesce("new_tag", "tag")).drop("new_tag").select(*df.columns)


def real_part(df: DataFrame, part: str = "re") -> DataFrame:
    """Samples (keys, s, v struct of re, im) as their real or imaginary part."""
    return df.withColumn("v", F.col(f"v.{part}"))


def is_complex(df: DataFrame, keys: Keys, tolerance: float = 1e-12) -> DataFrame:
    """(keys, complex): whether any sample's imaginary part reaches the tolerance times its size."""
    size = F.sqrt(F.col("v.re") * F.col("v.re") + F.col("v.im") * F.col("v.im"))
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(F.try_divide(F.abs(F.col("v.im")), size) >= tolerance), F.lit(False)).alias("complex"))


def member(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    """One member of struct samples as v, or with a value the samples with that member replaced."""
    return df.withColumn("v", F.col(f"v.{name}") if value is None else F.col("v").withField(name, value))


def weighted_by_key(df: DataFrame, keys: Keys, point: str, cut: Column) -> DataFrame:
    """(keys, s, v): error-weighted average over the points of each key that pass the cut."""
    return weighted_average(df.where(cut), point, keys)


def halves(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """(keys, half, mean, error): raw statistics of the front and the back half of n samples."""
    split = present(df).withColumn("half", F.when(F.col("s") < n // 2, F.lit("front")).otherwise(F.lit("back")))
    return split.groupBy(*keys, "half").agg(F.avg("v").alias("mean"), F.try_divide(F.stddev_pop("v"), F.sqrt(F.count("*") - 1)).alias("error"))


def expanded(df: DataFrame, keys: Keys, n: int, more: int) -> DataFrame:
    """Jackknife samples on n + more samples: those added stand at the mean."""
    means = present(df).groupBy(*keys).agg(F.avg("v").alias("v"))
    added = means.withColumn("s", F.explode(F.sequence(F.lit(n).cast("long"), F.lit(n + more - 1).cast("long"))))
    return df.select(*keys, F.col("s").cast("long").alias("s"), "v").unionByName(added.select(*keys, "s", "v"))


def momentum_product(source: DataFrame, sink: DataFrame, weights: DataFrame) -> DataFrame:
    """(t, s, v): sum of weight * source(p) * sink(q) over the pairs of momenta (p, q, weight).

    source and sink are (p, t, s, v); the weights of a projector are few and are
    sent to all tasks, and momenta without a weight are never joined.
    """
    left = source.join(F.broadcast(weights), "p").select("q", "t", "s", F.col("v").alias("_a"), "weight")
    right = sink.select(F.col("p").alias("q"), "t", "s", F.col("v").alias("_b"))
    return left.join(right, ["q", "t", "s"]).groupBy("t", "s").agg(F.sum(F.col("weight") * F.col("_a") * F.col("_b")).alias("v"))


def less_vacuum(product: DataFrame, bubble: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(t, s, v): a resampled product less the product of the resampled bubbles at the same sample, source and sink, or one of them twice.

    Bubbles are (s, v), or (t, s, v) where they depend on the time.
    """
    out = product
    for k, b in enumerate((bubble, other if other is not None else bubble)):
        out = out.join(b.select(*(c for c in ("t", "s") if c in b.columns), F.col("v").alias(f"_{k}")), [c for c in ("t", "s") if c in b.columns])
    return out.select("t", "s", (F.col("v") - F.col("_0") * F.col("_1")).alias("v"))


def mixing(type4: DataFrame, mix4: DataFrame) -> DataFrame:
    """(t, s, v): the coefficient alpha, what couples an operator to the vacuum over what couples the subtraction to it, sample by sample."""
    return matched(type4, mix4, ["t", "s"]).select("t", "s", F.try_divide("v", "_w").alias("v"))


def less_mixing(df: DataFrame, alpha: DataFrame, subtraction: DataFrame, scale: float = 1.0) -> DataFrame:
    """(t, s, v): df less scale * alpha * subtraction, all (t, s, v)."""
    product = matched(alpha, subtraction, ["t", "s"]).select("t", "s", (scale * F.col("v") * F.col("_w")).alias("v"))
    return matched(df, product, ["t", "s"]).select("t", "s", (F.col("v") - F.col("_w")).alias("v"))


def contracted(parts: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(t, s, v): sum of the diagrams (kind, t, s, v) by their coefficients; kinds without one are left out."""
    factor = F.create_map(*(x for k, c in coefficients.items() for x in (F.lit(k), F.lit(float(c)))))
    return parts.where(F.col("kind").isin(*coefficients)).groupBy("t", "s").agg(F.sum(factor[F.col("kind")] * F.col("v")).alias("v"))


def consistency(a: DataFrame, b: DataFrame, keys: Keys = ("t",)) -> DataFrame:
    """(keys, difference, error, deviations): jackknife difference of two results and how many errors it is from zero."""
    both = matched(a, b, [*keys, "s"]).select(*keys, "s", (F.col("v") - F.col("_w")).alias("v"))
    return jackknife_error(both, keys).select(*keys, F.col("mean").alias("difference"), "error", F.try_divide(F.abs("mean"), F.col("error")).alias("deviations"))


def histogram(df: DataFrame, keys: Keys, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, n): samples in equal bins from low to high; bin -1 holds those below, bin `bins` those from high on."""
    place = F.floor((F.col("v") - low) / (high - low) * bins)
    bin_ = F.when(F.col("v") < low, -1).when(F.col("v") >= high, bins).otherwise(F.least(place, F.lit(bins - 1))).cast("int")
    return present(df).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
