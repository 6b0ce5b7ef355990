"""Sources and sinks of resampled ensembles: XML and big-endian binary files, parameter tables, synthetic samples, regridding."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.operators.resampling import Keys, draw, jackknife_error

#: Fixed values of the XML layout.
SUPER, SINGLE = "SuperJackBoot", "Jackknife"
_ENSEMBLE = "struct<tag: string, SampleType: string, EnsembleSize: long, avg: double, values: string>"
_LIST = f"elem array<struct<SampleType: string, Nmeas: long, Nensembles: long, Ensembles: struct<elem: array<{_ENSEMBLE}>>>>"


def _or_error(wrong, text: str, value):
    """value, but an error when a row with something wrong is read."""
    return F.when(wrong, F.raise_error(F.lit(text)).cast("double")).otherwise(value)


def xml_ensembles(spark: SparkSession, paths: str) -> DataFrame:
    """(file, entry, ens, s, v) of XML files of jackknife ensembles side by side; s = -1 is the average.

    Ensembles of one entry must have the same average, as many values as they say,
    and add up to the entry's number of measurements; otherwise reading is an error.
    """
    entries = spark.read.format("xml").schema(_LIST).option("rowTag", "list").load(paths).select(F.col("_metadata.file_path").alias("file"), F.posexplode("elem").alias("entry", "e"))
    sizes = F.aggregate("e.Ensembles.elem", F.lit(0).cast("long"), lambda n, x: n + x["EnsembleSize"])
    low, high = F.array_min(F.transform("e.Ensembles.elem", lambda x: x["avg"])), F.array_max(F.transform("e.Ensembles.elem", lambda x: x["avg"]))
    wrong = (F.col("e.SampleType") != SUPER) | (sizes != F.col("e.Nmeas")) | (F.size("e.Ensembles.elem") != F.col("e.Nensembles")) | (low != high)
    each = entries.withColumn("_wrong", wrong).select("file", "entry", "_wrong", F.explode("e.Ensembles.elem").alias("x"))
    values = F.split(F.trim(F.regexp_replace("x.values", r"\s+", " ")), " ")
    each = each.withColumn("_values", values).withColumn("_wrong", F.col("_wrong") | (F.col("x.SampleType") != SINGLE) | (F.size("_values") != F.col("x.EnsembleSize")))
    samples = each.select("file", "entry", F.col("x.tag").alias("ens"), "_wrong", F.posexplode(F.concat(F.array(F.col("x.avg").cast("string")), "_values")).alias("s", "v"))
    return samples.select("file", "entry", "ens", (F.col("s") - 1).cast("long").alias("s"), _or_error(F.coalesce("_wrong", F.lit(True)), "not a file of jackknife ensembles", F.col("v").cast("double")).alias("v"))


def xml_dump(df: DataFrame, path: str, tag: str) -> None:
    """One series of jackknife samples (s, v) as an XML file of the same layout; its samples make one row, so this is for results."""
    whole = df.groupBy().agg(F.count("*").cast("string").alias("n"), F.avg("v").cast("string").alias("avg"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "v"))), lambda x: x["v"].cast("string")), " ").alias("values"))
    element = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    inner = element("elem", F.concat(element("tag", F.lit(tag)), element("SampleType", F.lit(SINGLE)), element("EnsembleSize", F.col("n")), element("avg", F.col("avg")), element("values", F.col("values"))))
    outer = element("elem", F.concat(element("SampleType", F.lit(SUPER)), element("Nmeas", F.col("n")), element("Nensembles", F.lit("1")), element("Ensembles", inner)))
    whole.select(F.concat(F.lit('<?xml version="1.0"?>'), element("data_in_file", F.concat(element("Nentries", F.lit("1")), element("list", outer)))).alias("value")).coalesce(1).write.text(path)


def unpacked(data: bytes) -> list[tuple[str, int, float]]:
    """(ens, s, v) of one big-endian file: jackknife samples (type 2), boots (3) or jackknife ensembles side by side (4).

    The average, or the boots' central value, is s = -1 of each ensemble; the first
    two have one, without a name.
    """
    at = 0

    def take(kind: str, n: int = 1) -> tuple:
        nonlocal at
        found = struct.unpack_from(f">{n}{kind}", data, at)
        at += struct.calcsize(f">{n}{kind}")
        return found

    kind, n = take("i", 2)
    if kind not in (2, 3, 4):
        raise ValueError(f"sample type 2, 3 or 4 expected, not {kind}")
    samples, (average,) = take("d", n), take("d")
    if kind != 4:
        if at != len(data):
            raise ValueError(f"sample type 4 expected, not {kind}: {len(data) - at} bytes follow the samples")
        return [("", -1, average), *(("", s, v) for s, v in enumerate(samples))]
    (ensembles,) = take("i")
    if any(k != 2 for k in take("i", ensembles)) or take("i")[0] != ensembles:
        raise ValueError("ensembles of jackknife samples expected")
    out, start = [], 0
    for _ in range(ensembles):
        _, _, size, _, kind = take("i", 5)
        end = data.index(b"\n", at)
        tag, at = data[at:end].decode(), end + 1
        if kind != 2:
            raise ValueError("ensembles of jackknife samples expected")
        out += [(tag, -1, average), *((tag, s, v) for s, v in enumerate(samples[start : start + size]))]
        start += size
    if start != n:
        raise ValueError(f"{start} samples in ensembles instead of {n}")
    return out


def binary_ensembles(spark: SparkSession, paths: str) -> DataFrame:
    """(file, ens, s, v) of big-endian binary files, each read by one task."""
    from samplewright.workers import on_workers

    on_workers(spark)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = pd.DataFrame(unpacked(bytes(content)), columns=["ens", "s", "v"])
                yield out.assign(file=path)[["file", "ens", "s", "v"]]

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(of, "file string, ens string, s long, v double")


def saved_parameters(parameters: DataFrame, names: Sequence[str], path: str, kind: str) -> DataFrame:
    """Fit parameters (s, names) as a table (s, name, v) with the kind of samples they are, written and read back."""
    long = parameters.unpivot(["s"], list(names), "name", "v").withColumn("kind", F.lit(kind))
    long.write.parquet(path)
    return parameters.sparkSession.read.parquet(path)


def loaded_parameters(spark: SparkSession, path: str, kind: str, names: Sequence[str]) -> DataFrame:
    """(s, names) of a table of saved_parameters; another kind of samples is an error."""
    found = spark.read.parquet(path)
    kinds = {r["kind"] for r in found.select("kind").distinct().collect()}  # one, or the table is wrong
    if kinds - {kind}:
        raise ValueError(f"samples of kind {', '.join(sorted(kinds))}, not {kind}")
    return found.groupBy("s").pivot("name", list(names)).agg(F.first("v")).select("s", *names)


def uniform(x: str, seed: int) -> str:
    """SQL for a number between 0 and 1, both excluded, from a whole number; the same in Spark and in DuckDB."""
    return f"(({draw(x, 2147483647, seed)} + 0.5D) / 2147483647)".replace("0.5D", "CAST(0.5 AS DOUBLE)")


def gaussian(x: str, seed: int) -> str:
    """SQL for a standard normal number from a whole number, by two uniform ones."""
    return f"sqrt(-2 * ln({uniform(x, seed)})) * cos(6.283185307179586 * {uniform(x, seed + 1)})"


def synthetic(spark: SparkSession, points: int, n: int, mean: float = 0.0, deviation: float = 1.0, kind: str = "gaussian", seed: int = 1234) -> DataFrame:
    """(t, s, v): n independent samples at each point, normal or (mean + deviation times) uniform; reruns agree."""
    number = {"gaussian": gaussian, "uniform": uniform}[kind]("id", seed)
    return spark.range(points * n).select(F.expr(f"id div {n}").alias("t"), F.expr(f"id % {n}").alias("s"), F.expr(f"{mean!r}D + {deviation!r}D * {number}").alias("v"))


def synthetic_jackknife(spark: SparkSession, points: int, n: int, mean: float, error: float, tolerance: float | None = None, seed: int = 1234, tries: int = 100) -> DataFrame:
    """(t, s, v): jackknife samples of exactly that mean, and of that error within a relative tolerance at every point."""
    for k in range(tries):
        raw = synthetic(spark, points, n, mean, error / (n - 1) ** 0.5, seed=seed + 2 * k)
        off = raw.groupBy("t").agg((F.avg("v") - mean).alias("_d"))
        out = raw.join(off, "t").select("t", "s", (F.col("v") - F.col("_d")).alias("v"))
        worst = None if tolerance is None else jackknife_error(out, ["t"]).agg(F.max(F.abs(F.col("error") / error - 1))).first()[0]
        if worst is None or worst <= tolerance:
            return out
    raise ValueError(f"no samples within {tolerance} in {tries} tries")


def regridded(df: DataFrame, keys: Keys = ("traj",)) -> DataFrame:
    """(keys, t, v): series measured at different times, brought to one grid by straight lines.

    The grid runs from the first to the last time of all, in steps as close to the
    smallest distance of neighbours as fits; beyond a series' own ends its outer
    lines carry on. A series of one time has no line and drops out.
    """
    order = W.partitionBy(*keys).orderBy("t")
    once = df.groupBy(*keys, "t").agg(F.min("v").alias("v"))
    line = once.withColumns({"_t2": F.lead("t").over(order), "_v2": F.lead("v").over(order), "_first": F.row_number().over(order) == 1}).where("_t2 IS NOT NULL")
    line = line.withColumn("_last", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("t"))) == 1)
    grid = once.agg(F.min("t").alias("_low"), F.max("t").alias("_high")).crossJoin(line.agg(F.min(F.col("_t2") - F.col("t")).alias("_d")))  # one row
    grid = grid.withColumn("_n", F.ceil((F.col("_high") - F.col("_low")) / F.col("_d"))).withColumn("_dt", (F.col("_high") - F.col("_low")) / F.col("_n"))
    at = line.join(F.broadcast(grid))
    # Places of the grid within [t, t2), those before and after the series with its outer lines.
    place = lambda c: F.ceil((F.col(c) - F.col("_low")) / F.col("_dt") - 1e-9)
    low = F.when(F.col("_first"), F.lit(0).cast("long")).otherwise(place("t"))
    high = F.when(F.col("_last"), F.col("_n")).otherwise(place("_t2") - 1)
    at = at.withColumn("_k", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    x = F.col("_low") + F.col("_k") * F.col("_dt")
    return at.select(*keys, x.alias("t"), (F.col("v") + (F.col("_v2") - F.col("v")) * (x - F.col("t")) / (F.col("_t2") - F.col("t"))).alias("v"))


def numbers(values: Sequence[float]) -> bytes:
    """Doubles in big-endian order, as the binary files hold them."""
    return np.asarray(values, ">f8").tobytes()
