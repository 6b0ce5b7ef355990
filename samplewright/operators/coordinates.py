"""Fits of points with several coordinates: three-point functions, series of several kinds, ratios, averages and frozen inputs.

A point's coordinates are columns. The distinct points of a fit are as few as its
range; they are numbered, and the fit sees their numbers, so that every covariance
strategy, minimiser and p-value works on them as it does on times.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import special
from samplewright.functions.expressions import column, symbols

from .fits import Function
from .resampling import Keys, jackknife_error, matched, moments, present

ROOT2 = 2.0**0.5


def placed(df: DataFrame, coordinates: Sequence[str], function: Function) -> tuple[DataFrame, Function]:
    """df (coordinates, s, v) as (t, s, v) with t the point's number, from 0 in order, and the function of coordinates as one of t."""
    points = [tuple(r) for r in present(df).select(*coordinates).distinct().collect()]  # the fit range
    if any(c is None for point in points for c in point):
        raise ValueError("a point lacks a coordinate")
    points.sort()
    x = np.array(points, float).reshape(len(points), len(coordinates))
    schema = ", ".join(["_t long", *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in coordinates)])
    numbers = df.sparkSession.createDataFrame([(k, *point) for k, point in enumerate(points)], schema)
    series = df.join(F.broadcast(numbers), list(coordinates)).select(F.col("_t").alias("t"), "s", "v")
    at = lambda t: x[np.rint(t).astype(int)]
    return series, Function(function.names, lambda t, p: function.value(at(t), p), lambda t, p: function.slope(at(t), p), function.guess)


def linear(dimensions: int) -> Function:
    """a0 + a1 x1 + ... of so many coordinates."""
    ones = lambda x: np.column_stack([np.ones(len(x)), x])
    return Function(
        tuple(f"a{k}" for k in range(dimensions + 1)), lambda x, p: p @ ones(x).T, lambda x, p: np.broadcast_to(ones(x), (len(p), len(x), dimensions + 1)), (0.0,) * (dimensions + 1)
    )


def three_point(sources: int = 1, sinks: int = 1, kinds: int = 1, constant: bool = False) -> Function:
    """Three-point functions of coordinates (t, separation[, kind]): source states decay for t, sink states for the rest.

    Sum over source states i and sink states j of A_src_i A_snk_j M_ij
    exp(-E_src_i t) exp(-E_snk_j (separation - t)) / sqrt(2), and C if wanted. Each
    kind has its own M, all else is shared. States are numbered where there are
    several, so is M by its source, sink and kind.
    """
    number = lambda k, n: str(k) if n > 1 else ""
    states = lambda end, n: [f"{c}_{end}{number(k, n)}" for k in range(n) for c in "AE"]
    several = sources > 1 or sinks > 1
    matrix = [f"M{f'{i}{j}' if several else ''}{f'_{k}' if kinds > 1 else ''}" for k in range(kinds) for i in range(sources) for j in range(sinks)]
    names = (*states("src", sources), *states("snk", sinks), *matrix, *(("C",) if constant else ()))
    guess = (*(v for k in range(sources) for v in (1.0, 0.5 + 0.3 * k)), *(v for k in range(sinks) for v in (1.0, 0.5 + 0.3 * k)), *([1.0] * len(matrix)), *([0.0] * constant))
    first = 2 * (sources + sinks)

    def parts(x, p):
        t, rest = x[None, :, 0, None], x[None, :, 1, None] - x[None, :, 0, None]
        kind = np.rint(x[:, 2]).astype(int) if kinds > 1 else np.zeros(len(x), int)
        a, e = p[:, None, 0 : 2 * sources : 2], p[:, None, 1 : 2 * sources : 2]
        b, f = p[:, None, 2 * sources : first : 2], p[:, None, 2 * sources + 1 : first : 2]
        m = p[:, first : first + len(matrix)].reshape(len(p), kinds, sources, sinks)[:, kind]
        near, far = np.exp(-e * t), np.exp(-f * rest)
        return t, rest, kind, a, b, m, near, far

    def value(x, p):
        _, _, _, a, b, m, near, far = parts(x, p)
        return np.einsum("sxi,sxij,sxj->sx", a * near, m, b * far) / ROOT2 + (p[:, -1:] if constant else 0.0)

    def slope(x, p):
        t, rest, kind, a, b, m, near, far = parts(x, p)
        out = np.zeros((len(p), len(x), len(names)))
        to_sink, to_source = np.einsum("sxij,sxj->sxi", m, b * far) / ROOT2, np.einsum("sxi,sxij->sxj", a * near, m) / ROOT2
        out[:, :, 0 : 2 * sources : 2] = near * to_sink
        out[:, :, 1 : 2 * sources : 2] = -t * a * near * to_sink
        out[:, :, 2 * sources : first : 2] = far * to_source
        out[:, :, 2 * sources + 1 : first : 2] = -rest * b * far * to_source
        whole = np.einsum("sxi,sxj->sxij", a * near, b * far).reshape(len(p), len(x), -1) / ROOT2
        size = sources * sinks
        for k in range(kinds):
            at = np.flatnonzero(kind == k)
            out[:, at, first + k * size : first + (k + 1) * size] = whole[:, at]
        if constant:
            out[:, :, -1] = 1.0
        return out

    return Function(names, value, slope, guess)


def joint(functions: Sequence[Function], names: Sequence[Mapping[str, str]], columns: Sequence[Sequence[int]]) -> Function:
    """One function of points whose last coordinate says which of the functions they follow, from 0.

    names says for each under which name each of its parameters is fitted; those of
    one name are shared. columns says which coordinates each takes; a function of
    one takes it alone.
    """
    all_ = tuple(dict.fromkeys(names[k][own] for k, f in enumerate(functions) for own in f.names))
    places = [[all_.index(names[k][own]) for own in f.names] for k, f in enumerate(functions)]
    guess = {names[k][own]: f.guess[j] for k, f in enumerate(functions) for j, own in enumerate(f.names)}

    def parts(x):
        kind = np.rint(x[:, -1]).astype(int)
        for k, f in enumerate(functions):
            at = np.flatnonzero(kind == k)
            own = x[at][:, list(columns[k])]
            yield f, at, own[:, 0] if len(columns[k]) == 1 else own, places[k]

    def value(x, p):
        out = np.full((len(p), len(x)), np.nan)
        for f, at, own, place in parts(x):
            out[:, at] = f.value(own, p[:, place])
        return out

    def slope(x, p):
        out = np.zeros((len(p), len(x), len(all_)))
        for f, at, own, place in parts(x):
            found = f.slope(own, p[:, place])
            for j, to in enumerate(place):
                out[:, at, to] += found[:, :, j]
        return out

    return Function(all_, value, slope, tuple(guess[n] for n in all_))


def ratio(three: DataFrame, source: DataFrame, sink: DataFrame, separation: int) -> DataFrame:
    """(t, s, v): a three-point function over the source's two-point function at t and the sink's at separation - t.

    A time of the three-point function that either lacks is an error when the result is read.
    """
    times = three.select("t", "s").distinct()
    kind = three.schema["t"].dataType
    back = sink.select((F.lit(separation) - F.col("t")).cast(kind).alias("t"), "s", "v")
    over = matched(source.join(times, ["t", "s"], "left_semi"), back.join(times, ["t", "s"], "left_semi"), ["t", "s"]).select("t", "s", (F.col("v") * F.col("_w")).alias("v"))
    return matched(three, over, ["t", "s"]).select("t", "s", F.try_divide("v", "_w").alias("v"))


def averaged(df: DataFrame, over: str, keys: Keys) -> DataFrame:
    """(keys, s, v): raw samples averaged over channels, weighted by the inverse squared standard errors of each.

    The weights are numbers, the same for all samples; so what is resampled from the
    result, its covariances too, is the same linear map of what is resampled from df.
    A channel without error makes it null.
    """
    errors = moments(df, [*keys, over]).select(*keys, over, F.try_divide(F.lit(1.0), F.col("standard_error") ** 2).alias("_w"))
    weighed = present(df).join(errors, [*keys, over])
    value = F.try_divide(F.sum(F.col("_w") * F.col("v")), F.sum("_w"))
    return weighed.groupBy(*keys, "s").agg(F.when(~F.bool_or(F.col("_w").isNull()), value).alias("v"))


def consistency(df: DataFrame, over: str, keys: Keys) -> DataFrame:
    """(keys, chi2, dof, p) of the channels' jackknife means about their weighted average; small p: they disagree."""
    means = jackknife_error(df, [*keys, over]).withColumn("_w", F.try_divide(F.lit(1.0), F.col("error") ** 2))
    sums = means.groupBy(*keys).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("mean")).alias("wm"), F.sum(F.col("_w") * F.col("mean") ** 2).alias("wmm"), (F.count("*") - 1).cast("int").alias("dof"))
    sums = sums.select(*keys, F.greatest(F.lit(0.0), F.expr("wmm - try_divide(wm * wm, w)")).alias("chi2"), "dof")
    return sums.withColumn("p", F.when(F.col("dof") > 0, special.chi2_p(F.col("chi2"), F.col("dof"))))


@dataclass(frozen=True)
class Frozen:
    """Where a frozen parameter's values come from: stored samples (indices, s, v) at the given indices, or none; a formula of x, or of nothing."""

    samples: DataFrame | None = None
    at: Mapping[str, object] | None = None
    formula: str | None = None


def frozen_values(sources: Mapping[str, Frozen], samples: DataFrame) -> DataFrame:
    """(s, a column a parameter): frozen values for each of the samples (s).

    Stored samples are mapped by a formula of x alone, if there is one; without
    stored samples the formula is of nothing and counts for all. A source that has
    not exactly one value for each of the samples is an error when the result is read.
    """
    wanted = samples.select("s").distinct()
    out = wanted.withColumn("_there", F.lit(True))
    clash = lambda name: F.raise_error(F.concat(F.lit(f"not one value of {name} at s = "), F.col("s").cast("string"))).cast("double")
    for name, source in sources.items():
        found = symbols(source.formula) if source.formula is not None else None
        if source.samples is None:
            if found != set():
                raise ValueError(f"{name}: without samples a formula of nothing is needed, not {source.formula!r}")
            out = out.withColumn(name, column(source.formula, {}))
            continue
        if found not in (None, {"x"}):
            raise ValueError(f"{name}: the formula must be of x alone: {source.formula!r}")
        rows = source.samples
        for index, value in (source.at or {}).items():
            rows = rows.where(F.col(index) == value)
        value = F.max("v") if source.formula is None else column(source.formula, {"x": F.max("v")})
        rows = rows.groupBy("s").agg(value.alias(name), F.count("v").alias("_n"))
        one = F.when((F.col("_n") == 1) & F.col("_there"), F.col(name)).otherwise(clash(name))
        out = out.join(rows, "s", "full").withColumn(name, one).drop("_n")
    return out.drop("_there")
