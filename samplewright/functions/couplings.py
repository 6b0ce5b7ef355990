"""The running coupling to two loops, and the scale at which it has a given value."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.workers import on_workers

#: Least scale that is looked for, share of the energy that it stays below, accuracy, most steps.
LEAST, BELOW, ACCURACY, STEPS = 1e-6, 0.99999, 1e-10, 200
GOLDEN = (3 - 5**0.5) / 2


def betas(flavours: int, colours: int = 3) -> tuple[float, float]:
    """The first two coefficients of the beta function."""
    casimir = (colours * colours - 1) / 2 / colours
    return (11 * colours - 2 * flavours) / 3, 34 / 3 * colours * colours - 10 / 3 * flavours * colours - 2 * casimir * flavours


def running(energy: Column, scale: Column, flavours: int, colours: int = 3) -> Column:
    """The coupling at an energy, for a scale in the same units below it; null for others."""
    b0, b1 = betas(flavours, colours)
    log = 2 * F.log(energy / scale)
    value = (4 * math.pi / b0) / log * (1 - (b1 / b0 / b0) * F.log(log) / log)
    return F.when((energy > scale) & (scale > 0), value)


def _running(energy: np.ndarray, scale: np.ndarray, flavours: int, colours: int) -> np.ndarray:
    b0, b1 = betas(flavours, colours)
    log = 2 * np.log(energy / scale)
    return 4 * math.pi / b0 / log * (1 - b1 / b0 / b0 * np.log(log) / log)


def minimum(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, accuracy: float = ACCURACY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Where f is least between low and high, for all elements at once, and whether that is known to the accuracy.

    Brent's steps: to the bottom of the parabola through the three best points where
    that falls well inside and the steps shrink, else by the golden section.
    """
    a, b = low.astype(float).copy(), high.astype(float).copy()
    x = a + GOLDEN * (b - a)
    w, v = x.copy(), x.copy()
    with np.errstate(all="ignore"):
        fx = f(x)
        fw, fv = fx.copy(), fx.copy()
        last, before = np.zeros_like(x), np.zeros_like(x)
        for _ in range(steps):
            middle = (a + b) / 2
            least = 1e-9 * np.abs(x) + accuracy / 4
            done = np.abs(x - middle) <= 2 * least - (b - a) / 2
            if done.all():
                break
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = np.where(q > 0, -p, p), np.abs(q)
            curved = (np.abs(before) > least) & (np.abs(p) < np.abs(q * before / 2)) & (p > q * (a - x)) & (p < q * (b - x))
            side = np.where(x < middle, b - x, a - x)
            step = np.where(curved, p / np.where(q == 0, 1, q), GOLDEN * side)
            before = np.where(curved, last, side)
            near = curved & ((x + step - a < 2 * least) | (b - x - step < 2 * least))
            step = np.where(near, np.where(x < middle, least, -least), step)
            step = np.where(np.abs(step) >= least, step, np.where(step > 0, least, -least))
            last = step
            u = np.where(done, x, x + step)
            fu = f(u)
            better = (fu <= fx) & ~done
            worse = ~better & ~done
            a, b = np.where(better & (u >= x), x, np.where(worse & (u < x), u, a)), np.where(better & (u < x), x, np.where(worse & (u >= x), u, b))
            second = worse & ((fu <= fw) | (w == x))
            third = worse & ~second & ((fu <= fv) | (v == x) | (v == w))
            v, fv = np.where(better | second, w, np.where(third, u, v)), np.where(better | second, fw, np.where(third, fu, fv))
            w, fw = np.where(better, x, np.where(second, u, w)), np.where(better, fx, np.where(second, fu, fw))
            x, fx = np.where(better, u, x), np.where(better, fu, fx)
        known = np.abs(x - (a + b) / 2) <= 2 * (1e-9 * np.abs(x) + accuracy / 4) - (b - a) / 2
    return x, known & np.isfinite(fx)


def matched_scale(df: DataFrame, energy: str, coupling: str, flavours: int, colours: int = 3, name: str = "scale") -> DataFrame:
    """df with the scale at which the coupling at that energy has that value: where their squared difference is least.

    Null where an input is missing, or no scale below the energy comes within 1e-6 of it.
    """
    on_workers(df.sparkSession)

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for energies, couplings in batches:
            mu, goal = (x.to_numpy(float, na_value=np.nan) for x in (energies, couplings))
            high = np.where(mu > LEAST / BELOW, BELOW * mu, np.nan)
            x, known = minimum(lambda s: (_running(mu, s, flavours, colours) - goal) ** 2, np.full_like(mu, LEAST), high)  # noqa: B023
            with np.errstate(all="ignore"):
                off = np.abs(_running(mu, x, flavours, colours) - goal)
            yield pd.Series(np.where(known & (off <= 1e-6), x, np.nan))

    value = of(F.col(energy).cast("double"), F.col(coupling).cast("double"))
    return df.withColumn(name, value).withColumn(name, F.when(~F.isnan(name), F.col(name)))
