"""Roots of equations, one set of unknowns a row, all rows of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from samplewright.workers import on_workers

#: Step of the difference quotients, largest size of an equation at a root, most steps, damping at first and how it changes.
DELTA, TOLERANCE, STEPS, START, FACTOR = 1e-4, 1e-4, 200, 1e-3, 10.0
#: Damping beyond which a row without progress ends.
MOST = 1e12

Equations = Callable[[np.ndarray, np.ndarray], np.ndarray]


def roots(equations: Equations, guess: np.ndarray, given: np.ndarray, tolerance: float = TOLERANCE, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x with equations(x, given) = 0: the unknowns, the largest size of an equation, whether that is within the tolerance.

    x is (rows, unknowns), given (rows, inputs), the equations (rows, as many as
    unknowns). Damped Newton steps with central differences; a row stops when no
    step helps it.
    """
    x = np.array(guess, float)
    n, k = x.shape

    def at(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.asarray(equations(x, given[rows]), float).reshape(len(x), k)

    all_ = np.arange(n)
    f = at(x, all_)
    cost = (f * f).sum(axis=1)
    damping, ended = np.full(n, START), ~np.isfinite(cost)
    for _ in range(STEPS):
        live = np.flatnonzero(~ended)
        if not len(live):
            break
        j = np.empty((len(live), k, k))
        for c in range(k):
            off = np.zeros(k)
            off[c] = delta
            j[:, :, c] = (at(x[live] + off, live) - at(x[live] - off, live)) / (2 * delta)
        sound = np.isfinite(j).all(axis=(1, 2))
        ended[live[~sound]] = True
        live, j = live[sound], j[sound]
        if not len(live):
            continue
        u, s, v = np.linalg.svd(j)
        c = np.einsum("sfk,sf->sk", u, f[live])
        # Damped by the slopes' own size.
        step = -np.einsum("skl,sk->sl", v, s * c / np.maximum(s * s + damping[live, None] * s[:, :1] ** 2, 1e-300))
        trial = x[live] + step
        new = at(trial, live)
        now = (new * new).sum(axis=1)
        better = np.isfinite(now) & (now < cost[live])
        took = live[better]
        x[took], f[took] = trial[better], new[better]
        ended[took[np.abs(step[better]).max(axis=1, initial=0) <= 1e-14 * np.maximum(1.0, np.abs(x[took]).max(axis=1, initial=0))]] = True
        cost[took] = now[better]
        damping[took] = np.maximum(damping[took] / FACTOR, 1e-15)
        stuck = live[~better]
        damping[stuck] *= FACTOR
        ended[stuck[damping[stuck] > MOST]] = True
        ended[live[cost[live] == 0]] = True
    worst = np.abs(f).max(axis=1, initial=0)
    return x, worst, np.isfinite(worst) & (worst <= tolerance)


def solved(df: DataFrame, equations: Equations, inputs: Sequence[str], unknowns: Mapping[str, float], tolerance: float = TOLERANCE, delta: float = DELTA) -> DataFrame:
    """df with the unknowns, null where no root was found or an input is missing, and residual, the largest size of an equation.

    unknowns gives each its guess.
    """
    on_workers(df.sparkSession)
    names = list(unknowns)
    clash = {*names, "residual"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {', '.join(sorted(clash))} are there already")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` double" for n in [*names, "residual"])])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = batch[list(inputs)].to_numpy(float, na_value=np.nan)
            x, worst, good = roots(equations, np.tile(np.array(list(unknowns.values()), float), (len(batch), 1)), given, tolerance, delta)
            x[~good] = np.nan
            found = {n: pd.Series(x[:, k], index=batch.index).astype("Float64").mask(np.isnan(x[:, k])) for k, n in enumerate(names)}
            yield batch.assign(**found, residual=pd.Series(worst, index=batch.index).astype("Float64").mask(~np.isfinite(worst)))

    return df.mapInPandas(of, schema)
