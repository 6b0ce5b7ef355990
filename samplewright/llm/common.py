"""What the operators share: reading tables, cutting lineage, joins with hot keys, importing on workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.workers import on_workers

__all__ = ["WORD", "dropped", "joined_spread", "n_words", "on_workers", "shared_dir", "table", "written"]

#: A word: a run of characters other than space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot from one in HOT_KEYS rows on (so there are no more of them than that), and from MIN_HOT rows on.
HOT_KEYS, MIN_HOT = 1000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the cluster's shared one.

    Where spark.checkpoint.dir is unset, a local master gets a temporary folder
    that goes when Python ends; on any other master that would lose rows, since
    each executor would write to its own disk, and is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. The
    schema is passed on so that reading needs no inference. All of an
    application's tables lie in one folder, which may go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove what written() wrote, once nothing will read it any more."""
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if f"/{application}/" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def joined_spread(rows: DataFrame, by_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with by_key, one row a key; hot keys are dealt over several tasks.

    by_key has in `_rows` how many of the rows have its key; `_rows` isn't in the
    result. Rows should be stored ones: a hot key's are dealt by their place, so
    that equal rows part too. Only rows of hot keys are dealt, and only their keys
    are copied; at most HOT_KEYS keys are sent to all tasks.
    """
    total = by_key.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    most = max(MIN_HOT, total // HOT_KEYS)
    hot = by_key.where(F.col("_rows") > most).select(*keys, (F.col("_rows") / most).cast("int").alias("_parts"))
    dealt = rows.join(F.broadcast(hot), list(keys), "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts") + 1).cast("int"), F.lit(0))).drop("_parts")
    copies = F.sequence(F.lit(0), F.when(F.col("_rows") > most, (F.col("_rows") / most).cast("int")).otherwise(0))
    return dealt.join(by_key.withColumn("_part", F.explode(copies)).drop("_rows"), [*keys, "_part"], how).drop("_part")


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
