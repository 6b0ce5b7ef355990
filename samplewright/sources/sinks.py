"""Sinks: samples as text or as tables that later runs read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_dump(df: DataFrame, path: str, coefficient: float = 1.0) -> None:
    """Lines `t s v 0`, v times the coefficient, in part files ordered by t and s."""
    line = F.concat_ws(" ", F.col("t").cast("string"), F.col("s").cast("string"), (F.col("v") * coefficient).cast("string"), F.lit("0"))
    df.orderBy("t", "s").select(line.alias("value")).write.text(path)


def saved(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df, written to path and read back: a checkpoint of raw or resampled data, resample tables, layouts or eigenvalues, in a folder for each value of `by`."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return loaded(df.sparkSession, path)


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """What saved wrote."""
    return spark.read.parquet(path)
