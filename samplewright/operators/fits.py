"""Non-linear fits of correlated series, one for each sample.

A sample's points within the fit range are gathered into one row (as many as the
range has, whatever the table holds), and a batch of rows is fitted at once: the
damped Gauss-Newton steps of all samples are one set of numpy operations. The
fit of the mean comes first and is the starting point of all others.

What is frozen, weighted or inverted is as large as the fit range squared and is
sent to the tasks, or travels with each sample where every sample has its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.workers import on_workers

from . import trust
from .resampling import present
from .weights import BY_SAMPLE, correlations, inverse, modified, of_covariance, shrunk_correlations, square, weight, with_means

__all__ = [
    "APART", "Function", "Options", "Problem", "at_points", "chi2_modes", "cosh", "cosh_mass", "degrees", "dispersion", "exponential", "fit", "fitted", "inverse", "modified", "parabola", "polynomial",
    "refitted_q2", "simultaneous", "sinh", "together",
]

#: Steps: damping at first, its bounds and factor, the change of chi-square that ends a fit, the most steps.
START, LEAST, MOST, FACTOR, TOLERANCE, STEPS = 1e-3, 1e-5, 1e6, 10.0, 1e-10, 500


@dataclass(frozen=True)
class Function:
    """A fit function: names of its parameters, value of (x, p) and its derivatives; p has the parameters last."""

    names: tuple[str, ...]
    value: Callable[[np.ndarray, np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray, np.ndarray], np.ndarray]
    guess: tuple[float, ...]


def _states(n: int, period: float | None, sign: float, constant: bool) -> Function:
    """Sum of n states A exp(-E x), each with its image at period - x times the sign, and a constant if wanted."""

    def parts(x, p):
        a, e = p[:, None, 0 : 2 * n : 2], p[:, None, 1 : 2 * n : 2]
        x = x[None, :, None]
        near = np.exp(-e * x)
        far = sign * np.exp(-e * (period - x)) if period is not None else 0.0
        return a, x, near, far

    def value(x, p):
        a, _, near, far = parts(x, p)
        return (a * (near + far)).sum(axis=2) + (p[:, None, 2 * n] if constant else 0.0)

    def slope(x, p):
        a, x3, near, far = parts(x, p)
        out = np.empty((len(p), len(x), p.shape[1]))
        out[:, :, 0 : 2 * n : 2] = near + far
        out[:, :, 1 : 2 * n : 2] = a * (-x3 * near - ((period - x3) * far if period is not None else 0.0))
        if constant:
            out[:, :, 2 * n] = 1.0
        return out

    names = tuple(f"{c}{k if n > 1 else ''}" for k in range(n) for c in "AE")
    guess = tuple(v for k in range(n) for v in ((1.0, 0.5) if k == 0 else (1.0, 0.5 + 0.5 * k)))
    return Function(names + ("C",) * constant, value, slope, guess + (0.0,) * constant)


def exponential(n: int = 1, constant: bool = False) -> Function:
    """Sum of A exp(-E x)."""
    return _states(n, None, 0.0, constant)


def cosh(period: float, n: int = 1, constant: bool = False) -> Function:
    """Sum of A (exp(-E x) + exp(-E (period - x)))."""
    return _states(n, period, 1.0, constant)


def sinh(period: float) -> Function:
    """A (exp(-E x) - exp(-E (period - x)))."""
    return _states(1, period, -1.0, False)


def polynomial(degree: int) -> Function:
    """a0 + a1 x + ...; degree 0 is a constant, 1 a line."""
    powers = lambda x: x[:, None] ** np.arange(degree + 1)
    return Function(
        tuple(f"a{k}" for k in range(degree + 1)), lambda x, p: p @ powers(x).T, lambda x, p: np.broadcast_to(powers(x), (len(p), len(x), degree + 1)), (0.0,) * (degree + 1)
    )


def parabola() -> Function:
    """A + B (x - C)^2."""
    return Function(
        ("A", "B", "C"), lambda x, p: p[:, :1] + p[:, 1:2] * (x - p[:, 2:]) ** 2,
        lambda x, p: np.stack([np.ones((len(p), len(x))), (x - p[:, 2:]) ** 2, -2 * p[:, 1:2] * (x - p[:, 2:])], axis=2), (0.0, 1.0, 0.0),
    )


def dispersion() -> Function:
    """The root of m^2 + c x, for x the squared momentum."""

    def slope(x, p):
        root = np.sqrt(p[:, :1] ** 2 + p[:, 1:] * x)
        return np.stack([p[:, :1] / root, x / (2 * root)], axis=2)

    return Function(("m", "c"), lambda x, p: np.sqrt(p[:, :1] ** 2 + p[:, 1:] * x), slope, (0.5, 1.0))


@dataclass(frozen=True)
class Options:
    """What binds a fit: frozen parameters, priors (value, width) and bounds (low, high; None: open) by name, a guess."""

    frozen: Mapping[str, float] = field(default_factory=dict)
    priors: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    guess: Sequence[float] | None = None


class _Bounded:
    """Parameters within bounds as free numbers: a sine between two bounds, a hyperbola above or below one."""

    def __init__(self, names: Sequence[str], bounds: Mapping[str, tuple[float | None, float | None]]):
        self.bounds = [(names.index(k), *b) for k, b in bounds.items() if k in names]

    def free(self, p: np.ndarray) -> np.ndarray:
        u = p.copy()
        for k, low, high in self.bounds:
            x = p[:, k]
            if low is not None and high is not None:
                u[:, k] = np.arcsin(np.clip(2 * (x - low) / (high - low) - 1, -1 + 1e-12, 1 - 1e-12))
            else:
                off = x - low if low is not None else high - x
                u[:, k] = np.sqrt(np.maximum((off + 1) ** 2 - 1, 1e-6))
        return u

    def bound(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parameters and their derivatives by the free numbers."""
        p, slope = u.copy(), np.ones_like(u)
        for k, low, high in self.bounds:
            x = u[:, k]
            if low is not None and high is not None:
                p[:, k], slope[:, k] = low + (np.sin(x) + 1) * (high - low) / 2, np.cos(x) * (high - low) / 2
            else:
                sign = 1.0 if low is not None else -1.0
                p[:, k], slope[:, k] = (low if low is not None else high) + sign * (np.sqrt(x * x + 1) - 1), sign * x / np.sqrt(x * x + 1)
        return p, slope


@dataclass
class Problem:
    """A set of fits of one function: its free parameters as unbound numbers, priors and start."""

    function: Function
    options: Options
    n: int
    guess: np.ndarray | None = None
    frozen: np.ndarray | None = None

    def __post_init__(self):
        names, options = list(self.function.names), self.options
        fixed = [names.index(k) for k in options.frozen]
        self.open = [k for k in range(len(names)) if k not in fixed]
        start = options.guess if options.guess is not None else self.function.guess
        start = np.tile(np.array(start, float), (self.n, 1)) if self.guess is None else np.array(self.guess, float).reshape(-1, len(names)) * np.ones((self.n, 1))
        if fixed:
            start[:, fixed] = list(options.frozen.values()) if self.frozen is None else self.frozen
        self.bounded = _Bounded(names, {k: b for k, b in options.bounds.items() if k not in options.frozen})
        self.pulls = [(names.index(k), value, width) for k, (value, width) in options.priors.items() if k not in options.frozen]
        self.start = self.bounded.free(start)


def fit(function: Function, x: np.ndarray, y: np.ndarray, weight: np.ndarray, options: Options = Options(), guess: np.ndarray | None = None, frozen: np.ndarray | None = None):
    """Parameters, chi-square and whether it converged, of each row of y.

    weight is the inverse covariance matrix, one for all rows or one each; frozen
    has a value for each row and frozen parameter, where they aren't one for all.
    """
    n = len(y)
    problem = Problem(function, options, n, guess, frozen)
    open_, bounded, pulls = problem.open, problem.bounded, problem.pulls
    w = np.broadcast_to(weight, (n, len(x), len(x)))

    def cost(p):
        with np.errstate(all="ignore"):
            r = y - function.value(x, p)
            out = np.einsum("si,sij,sj->s", r, w, r)
            for k, value, width in pulls:
                out = out + ((p[:, k] - value) / width) ** 2
        return r, np.where(np.isfinite(out), out, np.inf)

    u = problem.start
    p, _ = bounded.bound(u)
    r, best = cost(p)
    damping, done, failed = np.full(n, START), np.zeros(n, bool), ~np.isfinite(best)
    if not open_:
        return p, best, ~failed
    for _ in range(STEPS):
        live = np.flatnonzero(~done & ~failed)
        if not len(live):
            break
        _, chain = bounded.bound(u[live])
        with np.errstate(all="ignore"):
            j = (function.slope(x, p[live]) * chain[:, None, :])[:, :, open_]
            jw = np.einsum("sik,sij->skj", j, w[live])
            h, g = jw @ j, np.einsum("skj,sj->sk", jw, r[live])
        for k, value, width in pulls:
            at = open_.index(k)
            h[:, at, at] += (chain[:, k] / width) ** 2
            g[:, at] -= (p[live, k] - value) * chain[:, k] / width**2
        bad = ~(np.isfinite(h).all(axis=(1, 2)) & np.isfinite(g).all(axis=1))
        failed[live[bad]] = True
        live, h, g = live[~bad], h[~bad], g[~bad]
        diagonal = np.einsum("skk->sk", h)
        h = h + np.einsum("sk,kl->skl", damping[live, None] * np.maximum(diagonal, 1e-300), np.eye(len(open_)))
        try:
            step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            step = np.einsum("skl,sl->sk", np.linalg.pinv(h), g)
        trial = u[live].copy()
        trial[:, open_] += step
        tp, _ = bounded.bound(trial)
        saved = y, w
        y, w = y[live], w[live]
        tr, tc = cost(tp)
        y, w = saved
        better = tc <= best[live]
        change = np.where(better, best[live] - tc, np.inf)
        up = live[better]
        u[up], p[up], r[up], best[up] = trial[better], tp[better], tr[better], tc[better]
        done[live[change <= TOLERANCE * np.maximum(1.0, tc)]] = True
        damping[up] = np.maximum(damping[up] / FACTOR, LEAST)
        stuck = live[~better]
        # At the largest damping a step that still raises chi-square by a rounding error only is at the minimum.
        small = np.abs(tc[~better] - best[stuck]) <= 1e-9 * np.maximum(best[stuck], 1e-300)
        done[stuck[small & (damping[stuck] >= 1)]] = True
        failed[stuck[(damping[stuck] >= MOST) & ~small]] = True
        damping[stuck] = np.minimum(damping[stuck] * FACTOR, MOST)
    return p, best, done & ~failed


def _points(triangle, n_by: dict) -> np.ndarray:
    """A triangle's correlations as a matrix, and its sigmas, from rows with places in the fit range."""
    c = square([(n_by[r["t_i"]], n_by[r["t_j"]], r["correlation"]) for r in triangle if r["t_i"] in n_by and r["t_j"] in n_by], len(n_by))
    sigma = np.full(len(n_by), np.nan)
    for r in triangle:
        for t, name in (("t_i", "sigma_i"), ("t_j", "sigma_j")):
            if r[t] in n_by and r[name] is not None:
                sigma[n_by[r[t]]] = r[name]
    return c, sigma


def fitted(
    df: DataFrame, function: Function, low: float, high: float, strategy: str = "frozen", options: Options = Options(), frozen: DataFrame | None = None, cutoff: float | None = None,
    kind: str = "jackknife", size: int = 1, table: DataFrame | None = None, imported: DataFrame | None = None, inverted: bool = False, shrink: bool = False, modify: float | None = None, minimizer: str = "damped",
) -> DataFrame:
    """(s, parameters by name, chi2, dof, converged): a fit to the points low <= t <= high of each sample of df (t, s, v).

    Strategies: frozen (one covariance matrix from all samples) and uncorrelated (its
    diagonal); kind says what df holds then, jackknife samples, or bootstrap ones with
    the central row s = -1. correlated, block and hybrid take raw samples in df and
    give each resampled one its own matrix (see weights.correlations: size is that of
    bins, table a resample table for boots). imported (t_i, t_j[, s], correlation,
    sigma_i, sigma_j), a triangle that may hold the inverse correlations, stands in
    for the strategy's own; shrink, cutoff and modify change correlations before they
    are inverted. minimizer is "damped" or one of trust.METHODS. frozen (s, name of
    each frozen parameter) gives values by sample. Samples that lack a point of the
    range are left out.
    """
    on_workers(df.sparkSession)
    minimise = fit if minimizer == "damped" else partial(trust.fit, method=minimizer)
    df = present(df).where(F.col("t").between(low, high))
    by_sample = None
    if strategy in BY_SAMPLE:
        df, by_sample = correlations(df, strategy, size, table)
    if imported is not None:
        by_sample = imported if "s" in imported.columns else None
    if shrink:
        if by_sample is None:
            raise ValueError("how far to shrink is known from each sample's own matrix only")
        by_sample = shrunk_correlations(by_sample)
    treat = {"strategy": "uncorrelated" if strategy == "uncorrelated" else "correlated", "cutoff": cutoff, "modify": modify, "inverted": inverted}
    # One pass tells the fit range, its covariances and its means; their number is the range squared.
    found = [] if strategy in BY_SAMPLE else with_means(df.where("s >= 0"), kind).collect()
    means = {r["t_i"]: r["mean"] for r in found if r["t_i"] == r["t_j"]}
    points = sorted(means) if means else sorted(r["t"] for r in df.select("t").distinct().collect())
    x, place = np.array(points, float), {t: k for k, t in enumerate(points)}
    one = None
    if len(x) and by_sample is None:
        if imported is not None:
            one = weight(*_points(imported.collect(), place), **treat)
        else:
            matrix = square([(place[r["t_i"]], place[r["t_j"]], r["covariance"]) for r in found], len(x))
            one = of_covariance(matrix, treat["strategy"], cutoff, modify)
    rows = df.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("_y")).where(F.size("_y") == len(x))
    if frozen is not None:
        rows = rows.join(frozen.select("s", F.array(*(F.col(k).cast("double") for k in options.frozen)).alias("_f")), "s")
    guess = None
    if one is not None and means:
        p, _, good = minimise(function, x, np.array([[means[t] for t in points]]), one, options)
        guess = p[0] if good[0] else None
    if by_sample is not None:
        entries = F.collect_list(F.struct("t_i", "t_j", "correlation", "sigma_i", "sigma_j")).alias("_c")
        rows = rows.join(by_sample.groupBy("s").agg(entries), "s")
    dof = degrees(function, len(x), options)
    schema = ", ".join([f"s {df.schema['s'].dataType.simpleString()}", *(f"{n} double" for n in function.names), "chi2 double, dof int, converged boolean"])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            y = np.array([[e["v"] for e in row] for row in batch["_y"]], float)
            w = one if "_c" not in batch else np.stack([weight(*_points(row, place), **treat) for row in batch["_c"]])
            fixed = np.array(batch["_f"].tolist(), float) if "_f" in batch else None
            p, chi2, good = minimise(function, x, y, w, options, guess, fixed)
            out = pd.DataFrame(p, columns=list(function.names))
            yield pd.concat([batch[["s"]].reset_index(drop=True), out.assign(chi2=chi2, dof=dof, converged=good)], axis=1)

    return rows.mapInPandas(of, schema)


def degrees(function: Function, points: int, options: Options) -> int:
    """Degrees of freedom: points and priors less free parameters."""
    return points + sum(k not in options.frozen for k in options.priors) - (len(function.names) - len(options.frozen))


def chi2_modes(df: DataFrame, model: DataFrame, correlation: DataFrame, sigma: DataFrame) -> DataFrame:
    """(s, n, eigenvalue, contribution): chi-square of each sample by eigenmode of the correlation matrix.

    model (t, s, v) is the fit at the points; correlation (t_i, t_j, correlation)
    a triangle and sigma (t, sigma), both of the fit range's size.
    """
    points = sorted(r["t"] for r in sigma.select("t").collect())
    place = {t: k for k, t in enumerate(points)}
    c = square([(place[r["t_i"]], place[r["t_j"]], r["correlation"]) for r in correlation.select("t_i", "t_j", "correlation").collect()], len(points))
    values, vectors = np.linalg.eigh(c)
    modes = df.sparkSession.createDataFrame(
        [(n, float(x), t, float(vectors[place[t], k])) for n, (k, x) in enumerate(reversed(list(enumerate(values)))) for t in points], f"n int, eigenvalue double, t {df.schema['t'].dataType.simpleString()}, _u double"
    )
    off = df.join(model.select("t", "s", F.col("v").alias("_f")), ["t", "s"]).join(F.broadcast(sigma), "t")
    parts = off.join(F.broadcast(modes), "t").groupBy("s", "n", "eigenvalue").agg(F.sum(F.col("_u") * (F.col("v") - F.col("_f")) / F.col("sigma")).alias("_d"))
    return parts.select("s", "n", "eigenvalue", F.try_divide(F.col("_d") * F.col("_d"), F.col("eigenvalue")).alias("contribution"))


def at_points(parameters: DataFrame, function: Function, points: Sequence[float]) -> DataFrame:
    """(t, s, v): the function at the points for each sample's parameters."""
    on_workers(parameters.sparkSession)
    x = np.array(points, float)

    @F.pandas_udf("array<double>")
    def of(*p: pd.Series) -> pd.Series:
        return pd.Series(function.value(x, np.column_stack([c.to_numpy(float) for c in p])).tolist(), dtype=object)

    return parameters.select("s", F.posexplode(of(*function.names)).alias("_k", "v")).select(F.get(F.array(*map(F.lit, map(float, points))), F.col("_k")).alias("t"), "s", "v")


def refitted_q2(boots: DataFrame, function: Function, low: float, high: float, options: Options = Options(), strategy: str = "frozen") -> DataFrame:
    """(s, chi2) under the fit: boots (t, s, v, central row -1) are moved so that their mean is the central fit, then fitted again.

    The chi-square of the central row among those of the boots is the p-value's place.
    """
    centre = fitted(boots, function, low, high, strategy, options, kind="bootstrap").where("s = -1")
    points = sorted(r["t"] for r in boots.where(F.col("t").between(low, high)).select("t").distinct().collect())  # the fit range
    model = at_points(centre, function, points).select(F.col("t").cast(boots.schema["t"].dataType).alias("t"), F.col("v").alias("_f"))
    inside = boots.where(F.col("t").between(low, high) & (F.col("s") >= 0))
    means = inside.groupBy("t").agg(F.avg("v").alias("_m"))
    moved = inside.join(F.broadcast(means.join(model, "t")), "t").select("t", "s", (F.col("v") - F.col("_m") + F.col("_f")).alias("v"))
    again = fitted(moved, function, low, high, strategy, options, kind="bootstrap")
    return again.select("s", "chi2").unionByName(centre.select("s", "chi2"))


def cosh_mass(df: DataFrame, period: float, odd: bool = False) -> DataFrame:
    """(t, s, v): the m with C(t) / C(t + 1) = cosh(m (period / 2 - t)) / cosh(m (period / 2 - t - 1)), or sinh for odd series.

    A t where any sample has no such m drops out whole.
    """
    on_workers(df.sparkSession)
    following = present(df).select((F.col("t") - 1).alias("t"), "s", F.col("v").alias("_w"))

    @F.pandas_udf("double")
    def of(ratio: pd.Series, t: pd.Series) -> pd.Series:
        r, a = ratio.to_numpy(float, na_value=np.nan), period / 2 - t.to_numpy(float)
        b = a - 1
        with np.errstate(all="ignore"):
            if odd:
                size = lambda m, x: np.where(m == 0, np.log(np.abs(x)), m * np.abs(x) + np.log(-np.expm1(-2 * m * np.abs(x))))
                sign = np.sign(a * b)
            else:
                size = lambda m, x: np.logaddexp(m * x, -m * x)
                sign = np.ones_like(a)
            rising = np.where(np.abs(a) > np.abs(b), 1.0, -1.0)
            ahead = lambda m: rising * (size(m, a) - size(m, b))
            goal = rising * np.log(r * sign)
            low, high = np.zeros_like(r), np.full_like(r, 1e-3)
            for _ in range(40):
                high = np.where(ahead(high) < goal, high * 2, high)
            fine = (goal >= ahead(low)) & (ahead(high) >= goal) & (np.abs(a) != np.abs(b)) & ((sign != 0) | (not odd))
            for _ in range(200):
                middle = (low + high) / 2
                above = ahead(middle) >= goal
                low, high = np.where(above, low, middle), np.where(above, middle, high)
        return pd.Series(np.where(fine, (low + high) / 2, np.nan))

    masses = present(df).join(following, ["t", "s"]).select("t", "s", of(F.try_divide("v", "_w"), F.col("t").cast("double")).alias("v"))
    masses = masses.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    whole = masses.groupBy("t").agg(F.bool_and(F.col("v").isNotNull()).alias("_ok")).where("_ok").select("t")
    return masses.join(whole, "t", "left_semi")


#: Distance between the coordinates of two series that are fitted together.
APART = 1e6


def together(df: DataFrame, series: str = "series") -> DataFrame:
    """Samples (series, t, s, v) as one series for a simultaneous fit; series are whole numbers from 0."""
    return df.select((F.col(series) * APART + F.col("t")).alias("t"), "s", "v")


def simultaneous(functions: Sequence[Function], names: Sequence[Mapping[str, str]]) -> Function:
    """One function of all series: names says for each series under which name each of its parameters is fitted.

    Parameters of one name are shared.
    """
    all_ = tuple(dict.fromkeys(names[k][own] for k, f in enumerate(functions) for own in f.names))
    places = [[all_.index(names[k][own]) for own in f.names] for k, f in enumerate(functions)]
    guess = {names[k][own]: f.guess[j] for k, f in enumerate(functions) for j, own in enumerate(f.names)}

    def parts(x):
        which = np.floor((x + APART / 2) / APART).astype(int)
        return [(k, f, np.flatnonzero(which == k), x[which == k] - k * APART) for k, f in enumerate(functions)]

    def value(x, p):
        out = np.full((len(p), len(x)), np.nan)
        for k, f, at, own in parts(x):
            out[:, at] = f.value(own, p[:, places[k]])
        return out

    def slope(x, p):
        out = np.zeros((len(p), len(x), len(all_)))
        for k, f, at, own in parts(x):
            found = f.slope(own, p[:, places[k]])
            for j, place in enumerate(places[k]):
                out[:, at, place] += found[:, :, j]
        return out

    return Function(all_, value, slope, tuple(guess[n] for n in all_))
