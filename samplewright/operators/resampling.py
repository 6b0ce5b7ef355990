"""Resampling statistics on samples (keys, s, v): aggregates joined back by key.

Totals come from partial aggregates and are joined to the samples, so no window
holds a whole series in one task. What one sample, or two, can't give is null,
and so is what divides by zero (a constant series has no autocorrelation, a
series without error no weight). A null v is a missing sample: its row is left
out first, so that means and counts agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Keys = Sequence[str]


def present(df: DataFrame) -> DataFrame:
    """The samples that aren't missing."""
    return df.where("v IS NOT NULL")


def matched(a: DataFrame, b: DataFrame, keys: Keys) -> DataFrame:
    """(keys, v, _w): two quantities at the same keys; a key that only one of them has is an error when the result is read."""
    names = F.concat_ws(", ", *(F.concat(F.lit(f"{k} = "), F.col(k).cast("string")) for k in keys))
    both = a.select(*keys, "v", F.lit(True).alias("_a")).join(b.select(*keys, F.col("v").alias("_w"), F.lit(True).alias("_b")), list(keys), "full")
    lone = F.col("_a").isNull() | F.col("_b").isNull()
    return both.select(*keys, F.when(lone, F.raise_error(F.concat(F.lit("only one quantity has "), names)).cast("double")).otherwise(F.col("v")).alias("v"), "_w")


def totals(df: DataFrame, keys: Keys) -> DataFrame:
    """Sum and number of samples of each series."""
    return present(df).groupBy(*keys).agg(F.sum("v").alias("_sum"), F.count("*").alias("_n"))


def moments(df: DataFrame, keys: Keys) -> DataFrame:
    """Mean, population variance and deviation, range, standard error, third and fourth standardised moments."""
    return present(df).groupBy(*keys).agg(
        F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("deviation"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.try_divide(F.stddev_pop("v"), F.sqrt(F.count("*") - 1)).alias("standard_error"), F.skewness("v").alias("third"), (F.kurtosis("v") + 3).alias("fourth"),
    )


def binned(df: DataFrame, keys: Keys, size: int) -> DataFrame:
    """Means of `size` consecutive samples (s from 0); an incomplete bin, as the last may be, is cropped."""
    bins = present(df).groupBy(*keys, F.floor(F.col("s") / size).alias("_b")).agg(F.avg("v").alias("v"), F.count("*").alias("_n"))
    return bins.where(F.col("_n") == size).select(*keys, F.col("_b").alias("s"), "v")


def jackknife(df: DataFrame, keys: Keys) -> DataFrame:
    """Averages over all samples but one."""
    return present(df).join(totals(df, keys), list(keys)).select(*keys, "s", F.try_divide(F.col("_sum") - F.col("v"), F.col("_n") - 1).alias("v"))


def jackknife_error(df: DataFrame, keys: Keys) -> DataFrame:
    """Mean and error of jackknife samples."""
    return present(df).groupBy(*keys).agg(F.avg("v").alias("mean"), F.sqrt((F.count("*") - 1) * F.var_pop("v")).alias("error"))


def unjackknife(df: DataFrame, keys: Keys) -> DataFrame:
    """Raw samples that jackknife samples of a mean come from."""
    n = F.col("_n")
    return present(df).join(totals(df, keys), list(keys)).select(*keys, "s", (F.col("_sum") - (n - 1) * F.col("v")).alias("v"))


def pairs(df: DataFrame, key: str) -> DataFrame:
    """(key_i, key_j, s, x, y) with key_i <= key_j: samples of two series with the same index."""
    df = present(df)
    left = df.select(F.col(key).alias(f"{key}_i"), "s", F.col("v").alias("x"))
    right = df.select(F.col(key).alias(f"{key}_j"), "s", F.col("v").alias("y"))
    return left.join(right, "s").where(F.col(f"{key}_i") <= F.col(f"{key}_j"))


def covariance(df: DataFrame, key: str, kind: str = "raw") -> DataFrame:
    """Covariance of means between series, from raw, jackknife or bootstrap samples."""
    n = F.count("*") - 1
    value = {"raw": F.try_divide(F.covar_pop("x", "y"), n), "jackknife": F.covar_pop("x", "y") * n, "bootstrap": F.covar_pop("x", "y")}[kind]
    return pairs(df, key).groupBy(f"{key}_i", f"{key}_j").agg(value.alias("covariance"))


def double_jackknife_covariance(df: DataFrame, key: str) -> DataFrame:
    """For each outer sample the covariance of means over the inner ones, in closed form without N * N rows."""
    both = pairs(df, key)
    ij = [f"{key}_i", f"{key}_j"]
    sums = both.groupBy(*ij).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.count("*").alias("n"))
    inner = F.expr("try_divide(sxy - x * y, n - 1) - try_divide((sx - x) * (sy - y), (n - 1) * (n - 1))")
    return both.join(sums, ij).select(*ij, "s", F.try_divide(inner, F.col("n") - 2).alias("covariance"))


def double_jackknife(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, s, inner, v): averages over all samples but two. N * N rows, so bin first."""
    df = present(df)
    other = df.select(*keys, F.col("s").alias("inner"), F.col("v").alias("_w"))
    two = df.join(totals(df, keys), list(keys)).join(other, list(keys)).where("s <> inner")
    return two.select(*keys, "s", "inner", F.expr("try_divide(_sum - v - _w, _n - 2)").alias("v"))


def block_double_jackknife(df: DataFrame, keys: Keys, size: int) -> DataFrame:
    """(keys, block, s, v): averages without a block of samples and one more sample outside it."""
    df = present(df)
    n = df.groupBy(*keys).agg((F.floor(F.count("*") / size) * size).alias("_n"))
    kept = df.join(n, list(keys)).where("s < _n").withColumn("block", F.floor(F.col("s") / size))
    blocks = kept.groupBy(*keys, "block").agg(F.sum("v").alias("_part"))
    outer = blocks.join(kept.groupBy(*keys).agg(F.sum("v").alias("_sum")), list(keys))
    two = kept.withColumnRenamed("block", "_own").join(outer, list(keys)).where("block <> _own")
    return two.select(*keys, "block", "s", F.expr(f"try_divide(_sum - _part - v, _n - {size} - 1)").alias("v"))


def resample_table(spark, n: int, boots: int, size: int = 1, seed: int = 1234) -> DataFrame:
    """(b, pos, s): for each boot n - n mod size draws, in blocks of `size` neighbours, by a fixed hash."""
    blocks = n // size
    draws = spark.range(boots * blocks).select(F.expr(f"id div {blocks}").alias("b"), F.expr(f"id % {blocks}").alias("_p"), F.expr(draw("id", blocks, seed)).alias("_d"))
    within = draws.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return within.select("b", (F.col("_p") * size + F.col("_k")).alias("pos"), (F.col("_d") * size + F.col("_k")).alias("s"))


def _constants(seed: int) -> list[int]:
    return [zlib.crc32(f"{seed}:{k}".encode()) % 2147483646 + 1 for k in range(3)]


def drawn(x: int, n: int, seed: int = 0) -> int:
    """The number that draw() gives for x."""
    m, (a, b, c) = 2147483647, _constants(seed)
    first = (x % m * 48271 + (x >> 31) % m * 69621 + a) % m
    second = (first * first % m * b + first) % m
    return (second * second % m * 69621 + second + c) % m % n


def draw(x: str, n: int, seed: int = 0) -> str:
    """SQL for a pseudorandom number below n (n < 2^31) from a whole number x; the same in Spark and in DuckDB.

    Rounds of multiplication alone would stay linear in x and leave neighbouring
    draws correlated, so two of the rounds square. The seed sets constants of
    several rounds, so another seed's draws aren't these ones moved along. All 62
    bits of x count.
    """
    m, (a, b, c) = 2147483647, _constants(seed)
    first = f"(({x} % {m} * 48271 + (({x}) >> 31) % {m} * 69621 + {a}) % {m})"
    second = f"(({first} * {first} % {m} * {b} + {first}) % {m})"
    return f"(({second} * {second} % {m} * 69621 + {second} + {c}) % {m} % {n})"


def bootstrap(df: DataFrame, table: DataFrame, keys: Keys) -> DataFrame:
    """(keys, s, v): a mean for each boot, and the raw mean as the central row s = -1."""
    df = present(df)
    boots = df.join(table, "s").groupBy(*keys, F.col("b").alias("_b")).agg(F.avg("v").alias("v"))
    central = df.groupBy(*keys).agg(F.avg("v").alias("v"))
    return boots.select(*keys, F.col("_b").alias("s"), "v").unionByName(central.select(*keys, F.lit(-1).cast("long").alias("s"), "v"))


def bootstrap_error(df: DataFrame, keys: Keys, confidence: int = 68) -> DataFrame:
    """Central value, standard error about the boots' mean, and the confidence region's edges."""
    df = present(df)
    ranked = df.where("s >= 0").withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("v", "s")) - 1)
    n = df.where("s >= 0").groupBy(*keys).agg(F.count("*").alias("_n"))
    omit = (100 - confidence) // 2
    low = F.expr(f"{omit} * _n div 100")
    edges = ranked.join(n, list(keys)).groupBy(*keys).agg(
        F.stddev_pop("v").alias("error"), F.max(F.when(F.col("_r") == low, F.col("v"))).alias("low"), F.max(F.when(F.col("_r") == F.col("_n") - 1 - low, F.col("v"))).alias("high")
    )
    return df.where("s = -1").select(*keys, F.col("v").alias("central")).join(edges, list(keys))


def autocorrelation(df: DataFrame, keys: Keys, most: int, width: int = 4096) -> DataFrame:
    """(keys, lag, c, tau): autocorrelation by lag up to `most`, and its integral from 1/2.

    Samples go in blocks of `width` places; a block also gets the first ones of the
    next, so each row travels once and no task holds a whole series. Places may have
    gaps, and more than one sample: all pairs at a lag count.
    """
    width = max(width, most)
    df = present(df)
    block = F.floor(F.col("s") / width)
    stats = df.groupBy(*keys).agg(F.avg("v").alias("_mean"), F.var_pop("v").alias("_var"))
    # Joined by block, as a few keys would leave the rows to as many tasks.
    by_block = df.select(*keys, block.alias("_block")).union(df.where(F.pmod("s", F.lit(width)) < most).select(*keys, (block - 1).alias("_block"))).distinct()
    by_block = by_block.join(stats, list(keys))
    lent = F.when(F.pmod("s", F.lit(width)) < most, F.array(block, block - 1)).otherwise(F.array(block))
    rows = df.select(*keys, "s", "v", block.alias("_own"), F.explode(lent).alias("_block")).join(by_block, [*keys, "_block"])
    rows = rows.withColumn("_d", F.col("v") - F.col("_mean"))
    order = W.partitionBy(*keys, "_block").orderBy("s")
    at = [order.rangeBetween(lag, lag) for lag in range(most + 1)]
    rows = rows.select(*keys, "_own", "_block", "_d", "_var", *(c for lag, w in enumerate(at) for c in (F.sum("_d").over(w).alias(f"_sum{lag}"), F.count("_d").over(w).alias(f"_n{lag}"))))
    mine = rows.where("_own = _block")
    sums = mine.groupBy(*keys).agg(*(c for lag in range(most + 1) for c in (F.sum(F.expr(f"try_divide(_d * _sum{lag}, _var)")).alias(f"_sum{lag}"), F.sum(f"_n{lag}").alias(f"_n{lag}"))))
    lags = F.explode(F.array(*(F.struct(F.lit(lag).alias("lag"), F.col(f"_sum{lag}").alias("_sum"), F.col(f"_n{lag}").alias("_n")) for lag in range(most + 1))))
    by_lag = sums.select(*keys, lags.alias("_l")).select(*keys, "_l.*").where("_n > 0").select(*keys, "lag", (F.col("_sum") / F.col("_n")).alias("c"))
    upto = W.partitionBy(*keys).orderBy("lag")
    return by_lag.withColumn("tau", F.sum(F.when(F.col("lag") == 0, F.lit(0.5)).otherwise(F.col("c"))).over(upto))


def _weights(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, _w): inverse squared jackknife errors; null where there is no error."""
    return jackknife_error(df, keys).select(*keys, F.try_divide(F.lit(1.0), F.col("error") * F.col("error")).alias("_w"))


def weighted_average(df: DataFrame, key: str, keys: Keys = ()) -> DataFrame:
    """(keys, s, v): jackknife samples of the average of series, weighted by their inverse squared errors. A series without error makes it null."""
    weighed = present(df).join(_weights(df, [*keys, key]), [*keys, key])
    value = F.try_divide(F.sum(F.col("_w") * F.col("v")), F.sum("_w"))
    return weighed.groupBy(*keys, "s").agg(F.when(~F.bool_or(F.col("_w").isNull()), value).alias("v"))


def effective_mass(df: DataFrame, t: str = "t") -> DataFrame:
    """(t, s, v): logarithm of the ratio of neighbouring times; a t where any sample's ratio isn't positive drops out whole."""
    following = present(df).select((F.col(t) - 1).alias(t), "s", F.col("v").alias("_w"))
    ratios = present(df).join(following, [t, "s"]).select(t, "s", F.try_divide("v", "_w").alias("_r"))
    whole = ratios.groupBy(t).agg(F.bool_and(F.coalesce(F.col("_r") > 0, F.lit(False))).alias("_ok")).where("_ok").select(t)
    return ratios.join(whole, t, "left_semi").select(t, "s", F.log("_r").alias("v"))


def line_fit(df: DataFrame, t: str = "t") -> DataFrame:
    """(s, a, b, chi2): for each jackknife sample the line a + b t by weighted least squares; null if a t has no error or all are one t."""
    w, x, y = F.col("_w"), F.col(t), F.col("v")
    sums = present(df).join(_weights(df, [t]), t).groupBy("s").agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"), F.bool_or(w.isNull()).alias("_no")
    )
    fit = sums.withColumn("b", F.expr("IF(_no, NULL, try_divide(w * wxy - wx * wy, w * wxx - wx * wx))")).withColumn("a", F.expr("try_divide(wy - b * wx, w)"))
    return fit.select("s", "a", "b", F.expr("wyy - a * wy - b * wxy").alias("chi2"))


def superjackknife_error(df: DataFrame, keys: Keys, ensemble: str) -> DataFrame:
    """Error of a sum over independent ensembles: root of the sum of squared jackknife errors."""
    each = jackknife_error(df, [*keys, ensemble])
    return each.groupBy(*keys).agg(F.sum("mean").alias("mean"), F.sqrt(F.sum(F.col("error") ** 2)).alias("error"))


def relative_difference(a: DataFrame, b: DataFrame, keys: Keys) -> DataFrame:
    """2 (b - a) / (a + b) for each jackknife sample."""
    return matched(a, b, [*keys, "s"]).select(*keys, "s", F.expr("try_divide(2 * (_w - v), _w + v)").alias("v"))


def jackknife_to_double(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, s, inner, v): double jackknife of a mean from its jackknife samples. N * N rows, so bin first."""
    df = present(df)
    other = df.select(*keys, F.col("s").alias("inner"), F.col("v").alias("_w"))
    two = df.join(totals(df, keys), list(keys)).join(other, list(keys)).where("s <> inner")
    return two.select(*keys, "s", "inner", F.expr("try_divide(_n - 1, _n - 2) * (v + _w - try_divide(_sum, _n - 1))").alias("v"))


def double_to_jackknife(df: DataFrame, keys: Keys) -> DataFrame:
    """Means over the inner samples."""
    return df.groupBy(*keys, "s").agg(F.avg("v").alias("v"))


def boot_jackknife(df: DataFrame, table: DataFrame, keys: Keys) -> DataFrame:
    """(keys, b, s, v): a jackknife inside each boot, and that of the raw samples as boot -1."""
    df = present(df)
    boots = df.join(table, "s").select(*keys, "b", F.col("pos").alias("s"), "v").unionByName(df.select(*keys, F.lit(-1).cast("long").alias("b"), "s", "v"))
    return jackknife(boots, [*keys, "b"])


def boot_covariance(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Covariance of means inside each boot, and of the raw samples as boot -1, without the inner samples."""
    both = pairs(df, key)
    boots = both.join(table.select("b", "s"), "s").drop("s").unionByName(both.withColumn("b", F.lit(-1).cast("long")).drop("s"))
    return boots.groupBy(f"{key}_i", f"{key}_j", "b").agg(F.try_divide(F.covar_pop("x", "y"), F.count("*") - 1).alias("covariance"))


def neighbour_table(spark, n: int, boots: int, size: int, circular: bool = False, seed: int = 1234) -> DataFrame:
    """(b, pos, s): as resample_table, but blocks start at any sample; circular ones run on from the last to the first."""
    blocks = n // size
    starts = n if circular else n - size + 1
    draws = spark.range(boots * blocks).select(F.expr(f"id div {blocks}").alias("b"), F.expr(f"id % {blocks}").alias("_p"), F.expr(draw("id", starts, seed)).alias("_d"))
    within = draws.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return within.select("b", (F.col("_p") * size + F.col("_k")).alias("pos"), ((F.col("_d") + F.col("_k")) % n).alias("s"))


def super_boost(df: DataFrame, keys: Keys, ensemble: str, layout: dict[str, int]) -> DataFrame:
    """(keys, ens, s, v): jackknife samples of one ensemble on the layout of all; elsewhere their mean."""
    slots = F.array(*(F.struct(F.lit(e).alias("ens"), F.lit(n).alias("n")) for e, n in layout.items()))
    df = present(df)
    means = df.groupBy(*keys).agg(F.avg("v").alias("_m")).withColumn("_e", F.explode(slots))
    filled = means.select(*keys, "_m", "_e.ens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_e.n").cast("long") - 1)).alias("s"))
    own = df.select(*keys, F.lit(ensemble).alias("ens"), F.col("s").cast("long").alias("s"), "v")
    return filled.join(own, [*keys, "ens", "s"], "left").select(*keys, "ens", "s", F.coalesce("v", "_m").alias("v"))


def supermulti_error(df: DataFrame, keys: Keys, ensemble: str, kind: str) -> DataFrame:
    """Root of the summed squared errors of independent ensembles, jackknife (J) or bootstrap (B) each by its own formula."""
    of = F.var_pop("v") * F.when(F.col(kind) == "J", F.count("*") - 1).otherwise(1)
    return present(df).groupBy(*keys, ensemble, kind).agg(of.alias("_e")).groupBy(*keys).agg(F.sqrt(F.sum("_e")).alias("error"))


def bootstrap_autocorrelation(df: DataFrame, keys: Keys, most: int, size: int, boots: int, n: int, seed: int = 1234, means: DataFrame | None = None) -> DataFrame:
    """(keys, lag, s, v): for each boot the binned lag products' mean over that of lag 0; n - most pairs at every lag.

    means (keys, v) are those the products are taken about, where they aren't df's own.
    """
    df = present(df)
    mean = df.groupBy(*keys).agg(F.avg("v").alias("_mean")) if means is None else means.select(*keys, F.col("v").alias("_mean"))
    left = df.where(F.col("s") < n - most).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("_at", F.col("s") + F.col("lag"))
    right = df.select(*keys, F.col("s").alias("_at"), F.col("v").alias("_w"))
    products = left.join(right, [*keys, "_at"]).join(mean, list(keys)).select(*keys, "lag", "s", F.expr("(v - _mean) * (_w - _mean)").alias("v"))
    table = resample_table(df.sparkSession, (n - most) // size, boots, seed=seed)
    drawn = bootstrap(binned(products, [*keys, "lag"], size), table, [*keys, "lag"])
    zero = drawn.where("lag = 0").select(*keys, "s", F.col("v").alias("_z"))
    return drawn.join(zero, [*keys, "s"]).select(*keys, "lag", "s", F.expr("try_divide(v, _z)").alias("v"))


def jackknife_autocorrelation(df: DataFrame, keys: Keys, most: int, size: int, boots: int, n: int, seed: int = 1234) -> DataFrame:
    """(keys, lag, s, v): autocorrelation of n jackknife samples by lag, with boots of its binned products.

    All n - lag pairs of a lag count; a lag with fewer than two bins is left out.
    Each lag's boots draw from the same resample table of its own length.
    """
    df = present(df)
    stats = df.groupBy(*keys).agg(F.avg("v").alias("_mean"), F.var_pop("v").alias("_var"))
    left = df.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("_at", F.col("s") + F.col("lag"))
    right = df.select(*keys, F.col("s").alias("_at"), F.col("v").alias("_w"))
    products = left.join(right, [*keys, "_at"]).join(stats, list(keys)).select(*keys, "lag", "s", F.expr("try_divide((v - _mean) * (_w - _mean), _var)").alias("v"))
    bins = binned(products, [*keys, "lag"], size)
    lengths = {lag: (n - lag) // size for lag in range(most + 1) if (n - lag) // size >= 2}
    drawn = None
    for lag, length in lengths.items():
        own = bootstrap(bins.where(F.col("lag") == lag), resample_table(df.sparkSession, length, boots, seed=seed), [*keys, "lag"])
        drawn = own if drawn is None else drawn.unionByName(own)
    return drawn


def bin_jackknife(df: DataFrame, keys: Keys, size: int) -> DataFrame:
    """Jackknife of bins of `size` samples."""
    return jackknife(binned(df, keys, size), keys)


def integrated(df: DataFrame, keys: Keys) -> DataFrame:
    """(keys, lag, s, v): each boot's autocorrelation (keys, lag, s, v) summed up from lag 1 on, from 1/2 at lag 0."""
    upto = W.partitionBy(*keys, "s").orderBy("lag")
    return df.select(*keys, "lag", "s", F.sum(F.when(F.col("lag") == 0, F.lit(0.5)).otherwise(F.col("v"))).over(upto).alias("v"))


def weighted_average_double(df: DataFrame, key: str) -> DataFrame:
    """(s, inner, v): average of double jackknife series (key, s, inner, v), each outer sample weighted by its own inner errors."""
    df = present(df)
    weights = df.groupBy(key, "s").agg(F.try_divide(F.lit(1.0), (F.count("*") - 1) * F.var_pop("v")).alias("_w"))
    weighed = df.join(weights, [key, "s"])
    value = F.try_divide(F.sum(F.col("_w") * F.col("v")), F.sum("_w"))
    return weighed.groupBy("s", "inner").agg(F.when(~F.bool_or(F.col("_w").isNull()), value).alias("v"))


def effective_mass_less_constant(df: DataFrame, t: str = "t") -> DataFrame:
    """(t, s, v): effective mass of neighbours' differences, in which a constant drops out; three times make one."""
    following = present(df).select((F.col(t) - 1).alias(t), "s", F.col("v").alias("_w"))
    return effective_mass(present(df).join(following, [t, "s"]).select(t, "s", (F.col("v") - F.col("_w")).alias("v")), t)
