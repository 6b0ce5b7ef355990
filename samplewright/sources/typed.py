"""Tables of samples that know what they hold: kind, indices, layout and resample table travel in the schema.

The description is metadata of the column v, which Parquet files keep, so a table
read again, filtered or joined still tells. Tables of different kinds, layouts or
resample tables don't meet without an error.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that number the samples of each kind, and whether there is a central row s = -1.
KINDS: dict[str, tuple[tuple[str, ...], bool]] = {
    "raw": (("s",), False), "jackknife": (("s",), False), "jackknife_c": (("s",), True), "double_jackknife": (("s", "inner"), False), "super_jackknife": (("ens", "s"), False), "bootstrap": (("s",), True),
    "super_multi": (("ens", "kind", "s"), False),
}
_KEY = "samples"


def table_id(table: DataFrame) -> str:
    """What tells a resample table (b, pos, s) from others, whatever the order of its rows."""
    sums = table.select(F.xxhash64(F.col("b").cast("long"), F.col("pos").cast("long"), F.col("s").cast("long")).cast("decimal(20,0)").alias("h")).agg(F.sum("h"), F.count("*")).first()
    return f"{sums[1]}:{sums[0]}"


def layout_of(df: DataFrame, kind: str) -> dict[str, int]:
    """Number of samples, by ensemble where there are several; a row an ensemble comes to the driver."""
    columns, _ = KINDS[kind]
    by = [c for c in columns if c in ("ens", "kind")]
    rows = df.where("s >= 0").select(*by, "s").distinct().groupBy(*by).agg(F.count("*").alias("_n")).collect()
    return {"/".join(str(r[c]) for c in by) or "all": r["_n"] for r in rows}


def described(df: DataFrame, kind: str, indices: Sequence[str] = (), table: DataFrame | None = None) -> DataFrame:
    """df (indices, columns of the kind, v) with its description; what the kind asks for and df lacks is an error."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind}")
    columns, central = KINDS[kind]
    wanted = {*indices, *columns, "v"}
    if wanted != set(df.columns):
        raise ValueError(f"{kind} samples have columns {', '.join(sorted(wanted))}, not {', '.join(sorted(df.columns))}")
    if len(indices) > 2:
        raise ValueError("samples have two indices at most")
    if bool(df.where("s = -1").limit(1).count()) != central:
        raise ValueError(f"{kind} samples have {'a' if central else 'no'} central row")
    facts = {"kind": kind, "indices": list(indices), "layout": layout_of(df, kind), "table": table_id(table) if table is not None else None}
    return df.select(*indices, *columns, F.col("v").alias("v", metadata={_KEY: json.dumps(facts, sort_keys=True)}))


def description(df: DataFrame) -> dict:
    """Kind, indices, layout and resample table of samples; none is an error."""
    if "v" not in df.columns or _KEY not in df.schema["v"].metadata:
        raise ValueError("samples without a description")
    return json.loads(df.schema["v"].metadata[_KEY])


def kind_and_depth(df: DataFrame) -> tuple[str, int]:
    """The kind, and the number of indices, one at least: a single series counts as a list of one."""
    facts = description(df)
    return facts["kind"], max(1, len(facts["indices"]))


def required(df: DataFrame, kind: str | None = None, depth: int | None = None) -> DataFrame:
    """df, if it is of that kind and depth; else an error."""
    found = kind_and_depth(df)
    for what, want, have in (("kind", kind, found[0]), ("depth", depth, found[1])):
        if want is not None and want != have:
            raise ValueError(f"samples of {what} {have}, not {want}")
    return df


def agreeing(*tables: DataFrame) -> None:
    """An error unless all tables have one kind and one layout, and boots one resample table; indices may differ."""
    first, *rest = (description(t) for t in tables)
    for other in rest:
        for what in ("kind", "layout", "table"):
            if first[what] != other[what]:
                raise ValueError(f"samples of different {what}: {first[what]} and {other[what]}")


def saved(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Described samples, written in a folder for each value of `by`, and read back."""
    description(df)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return loaded(df.sparkSession, path)


def loaded(spark: SparkSession, path: str, kind: str | None = None, depth: int | None = None) -> DataFrame:
    """Described samples of a path; a wrong kind or depth is an error."""
    return required(spark.read.parquet(path), kind, depth)


def flattened(df: DataFrame, name: str = "i") -> DataFrame:
    """Samples of two indices with one, in the order of both; others stay as they are."""
    facts = description(df)
    if len(facts["indices"]) < 2:
        return df
    both = facts["indices"]
    order = df.select(*both).distinct().orderBy(*both).limit(1_000_001).collect()  # series, not samples
    if len(order) > 1_000_000:
        raise ValueError("more than a million series to number")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in both)
    places = df.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(order)], f"{kinds}, `_place` long")
    columns, _ = KINDS[facts["kind"]]
    facts["indices"] = [name]
    return df.join(places, both).select(F.col("_place").alias(name), *columns, F.col("v").alias("v", metadata={_KEY: json.dumps(facts, sort_keys=True)}))


def picked(spark: SparkSession, sources: Mapping[str, tuple[str, Mapping[str, object]]]) -> dict[str, DataFrame]:
    """Names of a formula to stored series: for each a path and a value for each index of the table there.

    An index without a value, a value without an index, a series that isn't there,
    or tables that don't agree are errors. The results (columns of the kind, v) are
    what expressions.calculated takes.
    """
    found = {}
    for name, (path, at) in sources.items():
        df = loaded(spark, path)
        facts = description(df)
        if set(at) != set(facts["indices"]):
            raise ValueError(f"{name}: values for {', '.join(facts['indices']) or 'no index'} are needed, not for {', '.join(at) or 'none'}")
        for index, value in at.items():
            df = df.where(F.col(index) == value)
        if not df.limit(1).count():
            raise ValueError(f"{name}: no series at {dict(at)} in {path}")
        found[name] = df.drop(*at)
    agreeing(*found.values())
    return found
