"""Measurements in files named by momenta: only those a projector needs are opened, and equivalents stand in for what lacks.

A template names a file: <TRAJ>, <FIG>, <TSEP>, <P1SRC>, <P1SNK> and, if need be,
<P2SRC> and <P2SNK> stand for trajectory, diagram, separation and momenta, written
as three numbers with _ for a minus. Momenta that aren't named follow from the
total: source ones add up to it, sink ones to its opposite.

The folder is listed once (a row a file, without contents), names are taken apart
by a pattern, and the momenta wanted are joined with those there and all that are
equivalent to them. The files chosen are then read by Spark. Their number is what
the projector asks for, times trajectories; that list of names goes through the
driver, as any list of paths to read does.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MOMENTA = ("p1src", "p2src", "p1snk", "p2snk")
_NUMBERS = {"TRAJ": "traj", "TSEP": "tsep"}
SYMMETRIES = ("parity", "axes", "auxiliary")
Momentum = tuple[int, int, int]


def written(p: Sequence[int]) -> str:
    """A momentum as it stands in file names."""
    return "".join(f"_{-x}" if x < 0 else str(x) for x in p)


def _pattern(template: str) -> tuple[str, list[str]]:
    """A regular expression of the template's file names, and what its groups are."""
    kinds, out = [], []
    for part in re.split(r"(<[A-Z0-9]+>)", template):
        if not part.startswith("<"):
            out.append(re.escape(part).replace(r"\/", "/"))
            continue
        name = part[1:-1]
        if name.lower() in MOMENTA:
            out.append(r"((?:_?\d){3})")
        elif name in _NUMBERS:
            out.append(r"(\d+)")
        elif name == "FIG":
            out.append("([A-Za-z]+)")
        else:
            raise ValueError(f"{part} is no part of a template")
        kinds.append(name)
    for needed in ("TRAJ", "P1SRC", "P1SNK"):
        if needed not in kinds:
            raise ValueError(f"the template lacks <{needed}>")
    return "".join(out) + "$", kinds


def _momentum(text: Column) -> Column:
    """array<int> of a momentum in a file name."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(_?\d)"), F.lit(1)), lambda x: F.regexp_replace(x, "_", "-").cast("int"))


def _opposite(p: Column) -> Column:
    return F.transform(p, lambda x: -x)


def _difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def catalogue(spark: SparkSession, folder: str, template: str, total: Momentum = (0, 0, 0)) -> DataFrame:
    """(path, traj, fig, tsep, p1src, p2src, p1snk, p2snk) of the folder's files that the template fits; contents aren't read.

    Files whose momenta don't add up to the total are left out.
    """
    pattern, kinds = _pattern(template)
    glob = f"{folder.rstrip('/')}/{re.sub(r'<[A-Z0-9]+>', '*', template)}"
    files = spark.read.format("binaryFile").load(glob).select("path")
    part = {name: F.regexp_extract("path", pattern, k + 1) for k, name in enumerate(kinds)}
    whole = F.lit([int(x) for x in total])
    p1src, p1snk = _momentum(part["P1SRC"]), _momentum(part["P1SNK"])
    p2src = _momentum(part["P2SRC"]) if "P2SRC" in part else _difference(whole, p1src)
    p2snk = _momentum(part["P2SNK"]) if "P2SNK" in part else _difference(_opposite(whole), p1snk)
    number = lambda name: part[name].cast("int") if name in part else F.lit(None).cast("int")
    found = files.where(F.col("path").rlike(pattern)).select(
        "path", number("TRAJ").alias("traj"), (part["FIG"] if "FIG" in part else F.lit(None).cast("string")).alias("fig"), number("TSEP").alias("tsep"),
        p1src.alias("p1src"), p2src.alias("p2src"), p1snk.alias("p1snk"), p2snk.alias("p2snk"),
    )
    sums = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    return found.where((sums("p1src", "p2src") == whole) & (sums("p1snk", "p2snk") == _opposite(whole)))


def _images(symmetries: Sequence[str]) -> list[tuple[int, tuple[str, ...], tuple[int, int, int], int]]:
    """(rank, which momentum goes where, order of axes, sign) of every combination; the fewest changes first."""
    if unknown := set(symmetries) - set(SYMMETRIES):
        raise ValueError(f"symmetries are {', '.join(SYMMETRIES)}, not {', '.join(sorted(unknown))}")
    signs = (1, -1) if "parity" in symmetries else (1,)
    orders = list(itertools.permutations(range(3))) if "axes" in symmetries else [(0, 1, 2)]
    # The auxiliary diagram has source and sink exchanged, with opposite momenta.
    ends = [MOMENTA, ("p1snk", "p2snk", "p1src", "p2src")] if "auxiliary" in symmetries else [MOMENTA]
    all_ = [(names, order, sign) for names in ends for order in orders for sign in signs]
    changes = lambda x: (x[2] != 1) + (x[1] != (0, 1, 2)) + (x[0] != MOMENTA)
    return [(k, *x) for k, x in enumerate(sorted(all_, key=lambda x: (changes(x), x[0] != MOMENTA, x[1], -x[2])))]


def chosen(there: DataFrame, wanted: DataFrame, symmetries: Sequence[str] = SYMMETRIES) -> DataFrame:
    """wanted (p1src, p1snk and, unless the total is 0, p2src, p2snk) with path, traj, fig, tsep and substituted.

    there is a catalogue. Of a trajectory, diagram and separation the file of the
    momenta themselves counts, else the equivalent one with the fewest changes, the
    first path of several. Momenta without any file have a row with path null.
    """
    if "p2src" not in wanted.columns:
        wanted = wanted.withColumns({"p2src": _opposite(F.col("p1src")), "p2snk": _opposite(F.col("p1snk"))})
    wanted = wanted.select(*MOMENTA).distinct()
    images = []
    for rank, names, order, sign in _images(symmetries):
        flip = sign * (1 if names == MOMENTA else -1)
        turned = [F.array(*(F.col(source)[k] * flip for k in order)).alias(target) for source, target in zip(names, MOMENTA, strict=True)]
        images.append(F.struct(F.lit(rank).alias("rank"), *turned))
    # As many rows a file as there are symmetries, 24 at most.
    spread = there.select("path", "traj", "fig", "tsep", F.explode(F.array(*images)).alias("x")).select("path", "traj", "fig", "tsep", "x.*")
    best = W.partitionBy(*MOMENTA, "traj", "fig", "tsep").orderBy("rank", "path")
    met = spread.join(F.broadcast(wanted), list(MOMENTA)).withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")
    return wanted.join(met, list(MOMENTA), "left").select(*MOMENTA, "path", "traj", "fig", "tsep", (F.col("rank") > 0).alias("substituted"))


def needed(weights: Sequence[tuple[Momentum, Momentum, float]], spark: SparkSession) -> DataFrame:
    """(p1src, p1snk, weight): a projector's momenta without those of no weight."""
    return spark.createDataFrame([(list(a), list(b), float(c)) for a, b, c in weights if c], "p1src array<int>, p1snk array<int>, weight double")


def measured(files: DataFrame) -> DataFrame:
    """chosen files' lines `source separation re im`: (momenta, traj, fig, tsep, tsrc, t, re, im, substituted); only these files are opened.

    Momenta without a file are an error.
    """
    spark = files.sparkSession
    rows = files.select(*MOMENTA, "path", "traj", "fig", "tsep", "substituted").collect()  # a row a file to open
    lacking = [tuple(map(tuple, (r["p1src"], r["p1snk"]))) for r in rows if r["path"] is None]
    if lacking:
        raise ValueError(f"no file, nor an equivalent one, for source and sink momenta {lacking[0]} and {len(lacking) - 1} more")
    if not rows:
        raise ValueError("no momenta are wanted")
    schema = "p1src array<int>, p2src array<int>, p1snk array<int>, p2snk array<int>, path string, traj int, fig string, tsep int, substituted boolean"
    keys = spark.createDataFrame([tuple(r) for r in rows], schema).withColumn("path", F.regexp_replace("path", r"^file:/+", "file:///"))
    lines = spark.read.text(sorted({r["path"] for r in rows})).select(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "file:///").alias("path"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))
    word = lambda k, kind: F.get("w", F.lit(k)).cast(kind)
    values = lines.where("w[0] <> ''").select("path", word(0, "int").alias("tsrc"), word(1, "int").alias("t"), word(2, "double").alias("re"), word(3, "double").alias("im"))
    # A file may serve several momenta.
    return values.join(keys, "path").select(*MOMENTA, "traj", "fig", "tsep", "tsrc", "t", "re", "im", "substituted")


def projected(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(traj, fig, tsep, tsrc, t, re, im): measurements summed with the projector's weights (p1src, p1snk, weight)."""
    rows = values.join(F.broadcast(weights), ["p1src", "p1snk"])
    return rows.groupBy("traj", "fig", "tsep", "tsrc", "t").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("re", "im")))
