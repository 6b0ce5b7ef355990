"""Measurements in text files, one file for each trajectory, as samples (t, s, v).

Files are found by a glob; a pattern with one group picks the trajectory's number
out of a file's path. Spark reads the files, so any store it knows will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _lines(spark: SparkSession, paths: str, pattern: str) -> DataFrame:
    """(traj, w): every line's words with the trajectory of its file."""
    number = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    lines = spark.read.text(paths).select(F.when(number != "", number).cast("long").alias("traj"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))
    return lines.where("w[0] <> '' AND traj IS NOT NULL")


def _word(k: int, kind: str = "double") -> Column:
    return F.get("w", F.lit(k)).cast(kind)


def standard(spark: SparkSession, paths: str, pattern: str) -> DataFrame:
    """(traj, t, v) from lines `t re im`; the real part counts."""
    return _lines(spark, paths, pattern).select("traj", _word(0, "int").alias("t"), _word(1).alias("v"))


def multi_source(spark: SparkSession, paths: str, pattern: str, period: int, imaginary: bool = False) -> DataFrame:
    """(traj, t, v) from lines `source separation re im`: sum over sources divided by the period."""
    lines = _lines(spark, paths, pattern).select("traj", _word(1, "int").alias("t"), _word(3 if imaginary else 2).alias("v"))
    return lines.groupBy("traj", "t").agg((F.sum("v") / period).alias("v"))


def inline(spark: SparkSession, paths: str, pattern: str) -> DataFrame:
    """(traj, t, v) from one line of values a file."""
    lines = _lines(spark, paths, pattern).select("traj", F.posexplode("w").alias("t", "v"))
    return lines.withColumn("v", F.col("v").cast("double"))


def in_range(df: DataFrame, start: int, step: int, stop: int, skip_missing: bool = False) -> DataFrame:
    """(t, s, v) of the (stop - start) div step trajectories from start on.

    A missing one is an error, unless skip_missing numbers those found anew; then
    trajectories that lack any coordinate go altogether.
    """
    n = (stop - start) // step
    at = F.col("traj") - start
    kept = df.where((at >= 0) & (at < n * step) & (at % step == 0)).select("t", (at / step).cast("long").alias("s"), "v")
    # One row a trajectory, at most n.
    whole = kept.groupBy("s").agg(F.countDistinct("t").alias("_k"))
    full = whole.agg(F.max("_k")).first()[0]
    whole = whole.where(F.col("_k") == full).select("s")
    if skip_missing:
        order = whole.withColumn("_s", F.row_number().over(W.orderBy("s")).cast("long") - 1)
        return kept.join(order, "s").select("t", F.col("_s").alias("s"), "v")
    if (found := whole.count()) != n:
        raise ValueError(f"{found} whole trajectories instead of {n}")
    return kept


def xy(spark: SparkSession, paths: str) -> DataFrame:
    """(x, y) from lines `x y`; lines of one value have no x."""
    w = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(paths).select(w.alias("w")).where("w[0] <> ''")
    return lines.select(F.when(F.size("w") > 1, _word(0)).alias("x"), F.when(F.size("w") > 1, _word(1)).otherwise(_word(0)).alias("y"))


def flow(spark: SparkSession, paths: str, pattern: str, squared: bool = True) -> DataFrame:
    """(traj, t, v) from lines `t v`; values that aren't `squared` yet are multiplied by t * t.

    A time may stand twice in a file if both values agree to 1e-12; otherwise
    reading is an error.
    """
    t, v = _word(0), _word(1)
    lines = _lines(spark, paths, pattern).select("traj", t.alias("t"), (v if squared else t * t * v).alias("v"))
    once = lines.groupBy("traj", "t").agg(F.min("v").alias("v"), F.max("v").alias("_most"))
    clash = F.raise_error(F.concat(F.lit("two values at t = "), F.col("t").cast("string"))).cast("double")
    return once.select("traj", "t", F.when(F.col("_most") - F.col("v") < 1e-12, F.col("v")).otherwise(clash).alias("v"))
