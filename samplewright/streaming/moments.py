"""Statistics of samples that keep arriving.

Number, mean and variance merge, so state is one row a series and window however
many samples there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _statistics() -> list[Column]:
    return [F.count("v").alias("n"), F.avg("v").alias("mean"), F.try_divide(F.stddev_pop("v"), F.sqrt(F.count("v") - 1)).alias("error")]


def running(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, mean, error; null for one sample) over all samples so far; for update or complete mode."""
    return df.groupBy(*keys).agg(*_statistics())


def windowed(df: DataFrame, keys: Sequence[str], time: str, width: str, late: str) -> DataFrame:
    """(start, keys, n, mean, error) by windows of time; samples later than `late` are left to the watermark.

    Times without a zone are read in the session's.
    """
    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(*_statistics()).select(F.col("window.start").alias("start"), *keys, "n", "mean", "error")
