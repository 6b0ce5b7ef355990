"""Operators on ensembles: central values, all-mode averaging, layouts, balanced resampling.

Everything is joins and aggregates by series and sample; no step gathers a series
in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resampling import Keys, draw, drawn, jackknife, pairs, present

ROUNDS = 16


def jackknife_with_centre(df: DataFrame, keys: Keys) -> DataFrame:
    """Jackknife samples, and the raw mean as the central row s = -1."""
    centre = present(df).groupBy(*keys).agg(F.avg("v").alias("v")).select(*keys, F.lit(-1).cast("long").alias("s"), "v")
    return jackknife(df, keys).withColumn("s", F.col("s").cast("long")).unionByName(centre)


def error_about_centre(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, central, error): jackknife error about the central row instead of the samples' mean."""
    sums = df.groupBy(*keys).agg(
        F.max(F.when(F.col("s") == -1, F.col("v"))).alias("central"), F.avg(F.when(F.col("s") >= 0, F.col("v"))).alias("_m"),
        F.var_pop(F.when(F.col("s") >= 0, F.col("v"))).alias("_d"), F.count_if((F.col("s") >= 0) & F.col("v").isNotNull()).alias("_n"),
    )
    return sums.select(*keys, "central", F.expr("sqrt((_n - 1) * (_d + (_m - central) * (_m - central)))").alias("error"))


def block_double_jackknife_covariance(df: DataFrame, key: str, size: int) -> DataFrame:
    """For each block left out the covariance of means over the samples outside it, in closed form without N * N / size rows."""
    df = present(df)
    n = df.groupBy(key).agg((F.floor(F.count("*") / size) * size).alias("_n"))
    kept = df.join(n, key).where("s < _n").select(key, "s", "v")
    ij = [f"{key}_i", f"{key}_j"]
    blocks = pairs(kept, key).groupBy(*ij, F.floor(F.col("s") / size).alias("block")).agg(
        F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.count("*").alias("c")
    )
    whole = blocks.groupBy(*ij).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("xy").alias("sxy"), F.sum("c").alias("n"))
    inner = F.expr("try_divide(try_divide(sxy - xy, n - c) - try_divide(sx - x, n - c) * try_divide(sy - y, n - c), n - c - 1)")
    return blocks.join(whole, ij).select(*ij, "block", inner.alias("covariance"))


def asymmetric_errors(region: DataFrame, keys: Keys) -> DataFrame:
    """(keys, central, up, down) from a central value and its confidence region (central, low, high)."""
    return region.select(*keys, "central", (F.col("high") - F.col("central")).alias("up"), (F.col("central") - F.col("low")).alias("down"))


def live_sources(df: DataFrame) -> DataFrame:
    """(s, tsrc) of the source slices that aren't zero throughout."""
    return df.where("v <> 0").select("s", "tsrc").distinct()


def source_average(df: DataFrame, live_only: bool = False) -> DataFrame:
    """(t, s, v): mean over sources tsrc, of all or of those that aren't zero throughout."""
    kept = df.join(live_sources(df), ["s", "tsrc"], "left_semi") if live_only else df
    return kept.groupBy("t", "s").agg(F.avg("v").alias("v"))


def correction(exact: DataFrame, sloppy: DataFrame) -> DataFrame:
    """(t, s, v): mean of exact less sloppy over the sources where the exact one was measured."""
    other = sloppy.select("tsrc", "t", "s", F.col("v").alias("_w"))
    both = exact.join(live_sources(exact), ["s", "tsrc"], "left_semi").join(other, ["tsrc", "t", "s"])
    return both.groupBy("t", "s").agg(F.avg(F.col("v") - F.col("_w")).alias("v"))


def sample_corrected(sloppy_s: DataFrame, sloppy_c: DataFrame, exact_c: DataFrame, keys: Keys) -> DataFrame:
    """(keys, ens, s, v): sloppy samples of S plus exact less sloppy ones of C, as jackknife samples of both ensembles.

    On S's samples C stands with its mean, and the other way round. All steps are
    linear, so C's difference is taken before it is resampled.
    """
    diff = exact_c.join(sloppy_c.select(*keys, "s", F.col("v").alias("_w")), [*keys, "s"]).select(*keys, "s", (F.col("v") - F.col("_w")).alias("v"))
    parts = {"S": (sloppy_s, diff), "C": (diff, sloppy_s)}
    out = [
        jackknife(own, keys).join(other.groupBy(*keys).agg(F.avg("v").alias("_m")), list(keys)).select(*keys, F.lit(ens).alias("ens"), "s", (F.col("v") + F.col("_m")).alias("v"))
        for ens, (own, other) in parts.items()
    ]
    return out[0].unionByName(out[1])


def averaged_over(df: DataFrame, left: Keys, among=None) -> DataFrame:
    """Mean of v over all dimensions but those left; `among` (a condition) picks the entries that count."""
    return (df if among is None else df.where(among)).groupBy(*left).agg(F.avg("v").alias("v"))


def joined_layout(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tag, size) of the ensembles of either layout; a tag with two sizes is an error when the result is read."""
    sizes = a.select("tag", "size").unionByName(b.select("tag", "size")).groupBy("tag").agg(F.min("size").alias("size"), F.max("size").alias("_most"))
    clash = F.raise_error(F.concat(F.lit("ensemble of two sizes: "), "tag")).cast(a.schema["size"].dataType)
    return sizes.select("tag", F.when(F.col("size") == F.col("_most"), F.col("size")).otherwise(clash).alias("size"))


def told_apart(df: DataFrame) -> DataFrame:
    """Ensembles (tag, size) once each; a tag with several sizes becomes tag_size."""
    many = df.groupBy("tag").agg((F.min("size") < F.max("size")).alias("_many"))
    named = df.select("tag", "size").distinct().join(many, "tag")
    return named.select(F.when(F.col("_many"), F.concat_ws("_", "tag", F.col("size").cast("string"))).otherwise(F.col("tag")).alias("tag"), "size")


def _offset(r: int, m: int, seed: int) -> int:
    """A round's number below m: a place x may swap with this less x. Two draws, so that it covers any range."""
    return (drawn(r + 77, 2147483647, seed) * 2147483648 + drawn(r + 777, 2147483647, seed)) % m


def permuted(x: str, r: int, m: int, seed: int = 0) -> str:
    """SQL for round r of swap-or-not: a permutation of 0 to m - 1 (m < 2^58), the same in Spark and in DuckDB."""
    partner = f"((({_offset(r, m, seed)} - {x}) % {m} + {m}) % {m})"
    return f"(CASE WHEN {draw(f'(greatest({x}, {partner}) * {ROUNDS} + {r})', 2, seed)} = 1 THEN {partner} ELSE {x} END)"


def permutation(x: str, m: int, seed: int = 0) -> str:
    """Spark SQL for all rounds: a pseudorandom permutation of 0 to m - 1. Lambdas name what a round uses more than once."""
    rounds = ", ".join(f"named_struct('o', {_offset(r, m, seed)}L, 'r', {r}L)" for r in range(ROUNDS))
    # After "array" Spark's lexer reads >> as the end of a type.
    drawing = draw("h", 2, seed).replace("((h) >> 31)", "shiftright(h, 31)")
    coin = f"transform(array(greatest(x, y) * {ROUNDS} + r.r), h -> {drawing})[0] = 1"
    return f"aggregate(array({rounds}), {x}, (x, r) -> transform(array(pmod(r.o - x, {m}L)), y -> IF({coin}, y, x))[0])"


def balanced_table(spark, n: int, boots: int, size: int = 1) -> DataFrame:
    """(b, pos, s): every block of `size` neighbours is drawn exactly `boots` times over all boots.

    As many copies of the blocks as there are boots are permuted by place, so
    nothing is sorted and no task holds the table.
    """
    blocks = n // size
    m = boots * blocks
    place = F.expr(permutation("id", m))
    drawn = spark.range(m).select(F.expr(f"id div {blocks}").alias("b"), F.expr(f"id % {blocks}").alias("_p"), (place % blocks).alias("_d"))
    within = drawn.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return within.select("b", (F.col("_p") * size + F.col("_k")).alias("pos"), (F.col("_d") * size + F.col("_k")).alias("s"))
