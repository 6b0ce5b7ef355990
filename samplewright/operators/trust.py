"""Least squares within trust regions, on residual vectors, all samples of a batch at once.

Chi-square is a sum of squared residuals by eigenmode of the inverse covariance,
and of pulls of priors. A step solves the linear problem by singular values of
the Jacobian, never by its square, so ill-conditioned parameters keep their
digits. Steps are bound by a radius in parameters scaled by the largest slopes
seen; the radius follows how well the linear problem foretold chi-square.
"""

from __future__ import annotations

import numpy as np

#: lm: damped steps; lmaccel: with their geodesic acceleration; dogleg and ddogleg: bent paths from the steepest to the full step; subspace: the best step in the plane of both.
METHODS = ("lm", "lmaccel", "dogleg", "ddogleg", "subspace")
#: Relative change of chi-square, of parameters, and size of the gradient that end a fit; most steps; how the radius grows and shrinks; longest acceleration.
CHANGE, MOVE, FLAT, STEPS, UP, DOWN, ACCELERATION = 1e-10, 1e-10, 1e-12, 1000, 3.0, 2.0, 0.75


def roots_of(weight: np.ndarray) -> np.ndarray:
    """Rows r with r^T r = weight, by eigenmode; of one matrix or a stack."""
    values, vectors = np.linalg.eigh(weight)
    return np.sqrt(np.maximum(values, 0))[..., :, None] * np.swapaxes(vectors, -1, -2)


def terms(function, x: np.ndarray, y: np.ndarray, p: np.ndarray, sigma: np.ndarray, correlation: np.ndarray, priors=()) -> tuple[np.ndarray, np.ndarray]:
    """Residuals whose halved squares add up to chi-square, and their Jacobian: a mode of the correlation matrix each, then priors (place, value, width)."""
    values, vectors = np.linalg.eigh(correlation)
    mode = np.sqrt(2.0) * vectors.T / np.sqrt(values)[:, None] / sigma[None, :]
    f = (y - function.value(x, p)) @ mode.T
    j = -np.einsum("ai,sik->sak", mode, function.slope(x, p))
    for place, value, width in priors:
        f = np.concatenate([f, np.sqrt(2.0) * (p[:, place : place + 1] - value) / width], axis=1)
        row = np.zeros((len(p), 1, p.shape[1]))
        row[:, 0, place] = np.sqrt(2.0) / width
        j = np.concatenate([j, row], axis=1)
    return f, j


def _full(u: np.ndarray, s: np.ndarray, v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The step to the linear problem's minimum; directions without slope stay."""
    c = np.einsum("smk,sm->sk", u, f)
    small = s <= s[:, :1] * 1e-13
    return -np.einsum("skl,sk->sl", v, np.where(small, 0.0, c / np.where(small, 1.0, s)))


def _damped(u: np.ndarray, s: np.ndarray, v: np.ndarray, f: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step of length radius at most, and the damping it takes."""
    c = np.einsum("smk,sm->sk", u, f)
    size = lambda mu: np.linalg.norm(s * c / np.maximum(s * s + mu[:, None], 1e-300), axis=1)
    low, high = np.zeros(len(f)), np.linalg.norm(s * c, axis=1) / np.maximum(radius, 1e-300) + 1e-300
    free = np.linalg.norm(_full(u, s, v, f), axis=1) <= radius
    for _ in range(60):
        middle = np.where(low > 0, np.sqrt(np.maximum(low, 1e-300) * high), high * 1e-8 + low)
        longer = size(middle) > radius
        low, high = np.where(longer, middle, low), np.where(longer, high, middle)
    mu = np.where(free, 0.0, high)
    step = -np.einsum("skl,sk->sl", v, s * c / np.maximum(s * s + mu[:, None], 1e-300))
    return np.where(free[:, None], _full(u, s, v, f), step), mu


def _bent(full: np.ndarray, steepest: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The point of the path from 0 by the steepest to the full step that the radius reaches."""
    a, b = np.linalg.norm(steepest, axis=1), np.linalg.norm(full, axis=1)
    d = full - steepest
    dd, sd = (d * d).sum(axis=1), (steepest * d).sum(axis=1)
    root = np.sqrt(np.maximum(sd * sd + dd * (radius**2 - a * a), 0))
    share = np.where(dd > 0, (root - sd) / np.where(dd > 0, dd, 1.0), 0.0)
    on_way = steepest + share[:, None] * d
    short = steepest * (radius / np.maximum(a, 1e-300))[:, None]
    return np.where((b <= radius)[:, None], full, np.where((a >= radius)[:, None], short, on_way))


def _plane(j: np.ndarray, f: np.ndarray, full: np.ndarray, gradient: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The best step of length radius at most in the plane of the gradient and the full step."""
    first = gradient / np.maximum(np.linalg.norm(gradient, axis=1), 1e-300)[:, None]
    rest = full - (full * first).sum(axis=1)[:, None] * first
    long = np.linalg.norm(rest, axis=1)
    second = np.where((long > 1e-12 * np.linalg.norm(full, axis=1))[:, None], rest / np.maximum(long, 1e-300)[:, None], 0.0)
    basis = np.stack([first, second], axis=2)
    u, s, v = np.linalg.svd(j @ basis, full_matrices=False)
    step, _ = _damped(u, s, v, f, radius)
    return np.einsum("skp,sp->sk", basis, step)


def fit(function, x: np.ndarray, y: np.ndarray, weight: np.ndarray, options=None, guess: np.ndarray | None = None, frozen: np.ndarray | None = None, method: str = "lm"):
    """Parameters, chi-square and whether it converged, of each row of y; arguments as those of fits.fit."""
    from .fits import Options, Problem

    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    n = len(y)
    problem = Problem(function, options if options is not None else Options(), n, guess, frozen)
    good = np.isfinite(weight).all(axis=(-1, -2)) & np.ones(n, bool)
    modes = np.broadcast_to(roots_of(np.where(np.isfinite(weight), weight, 0.0)), (n, len(x), len(x)))

    def residuals(u: np.ndarray, at: np.ndarray) -> np.ndarray:
        p, _ = problem.bounded.bound(u)
        with np.errstate(all="ignore"):
            f = np.einsum("sai,si->sa", modes[at], y[at] - function.value(x, p))
        return np.concatenate([f, *(((p[:, k] - value) / width)[:, None] for k, value, width in problem.pulls)], axis=1)

    def jacobian(u: np.ndarray, at: np.ndarray) -> np.ndarray:
        p, chain = problem.bounded.bound(u)
        with np.errstate(all="ignore"):
            j = -modes[at] @ (function.slope(x, p) * chain[:, None, :])
        for k, _, width in problem.pulls:
            row = np.zeros((len(u), 1, u.shape[1]))
            row[:, 0, k] = chain[:, k] / width
            j = np.concatenate([j, row], axis=1)
        return j[:, :, problem.open]

    all_ = np.arange(n)
    u = problem.start
    f = residuals(u, all_)
    cost = (f * f).sum(axis=1)
    failed, done = ~good | ~np.isfinite(cost), np.zeros(n, bool)
    if not problem.open:
        return problem.bounded.bound(u)[0], np.where(np.isfinite(cost), cost, np.inf), ~failed
    scale, radius = np.zeros((n, len(problem.open))), np.full(n, np.nan)
    for _ in range(STEPS):
        live = np.flatnonzero(~done & ~failed)
        if not len(live):
            break
        j, own = jacobian(u[live], live), f[live]
        sound = np.isfinite(j).all(axis=(1, 2))
        failed[live[~sound]] = True
        live, j, own = live[sound], j[sound], own[sound]
        if not len(live):
            continue
        scale[live] = np.maximum(scale[live], np.linalg.norm(j, axis=1))
        d = np.where(scale[live] > 0, scale[live], 1.0)
        j = j / d[:, None, :]
        gradient = np.einsum("smk,sm->sk", j, own)
        start = np.isnan(radius[live])
        radius[live[start]] = 0.3 * np.maximum(1.0, np.linalg.norm(d * u[live][:, problem.open], axis=1))[start]
        r = radius[live]
        left, sizes, right = np.linalg.svd(j, full_matrices=False)
        full = _full(left, sizes, right, own)
        accepted = np.ones(len(live), bool)
        if method in ("lm", "lmaccel"):
            step, mu = _damped(left, sizes, right, own, r)
        else:
            along = np.einsum("smk,sk->sm", j, gradient)
            steepest = -gradient * ((gradient**2).sum(axis=1) / np.maximum((along**2).sum(axis=1), 1e-300))[:, None]
            if method == "subspace":
                step = _plane(j, own, full, gradient, r)
            else:
                if method == "ddogleg":
                    gain = (gradient**2).sum(axis=1) ** 2 / np.maximum((along**2).sum(axis=1) * np.abs((gradient * full).sum(axis=1)), 1e-300)
                    bias = np.where(np.linalg.norm(full, axis=1) <= r, 1.0, 0.2 + 0.8 * np.minimum(gain, 1.0))
                    full = full * bias[:, None]
                step = _bent(full, steepest, r)
        if method == "lmaccel":
            h = 0.1
            ahead = u[live].copy()
            ahead[:, problem.open] += h * step / d
            with np.errstate(all="ignore"):
                second = 2 / h * ((residuals(ahead, live) - own) / h - np.einsum("smk,sk->sm", j, step))
            c = np.einsum("smk,sm->sk", left, np.where(np.isfinite(second), second, 0.0))
            bend = -np.einsum("skl,sk->sl", right, sizes * c / np.maximum(sizes**2 + mu[:, None], 1e-300))
            accepted = np.linalg.norm(bend, axis=1) <= ACCELERATION * np.linalg.norm(step, axis=1)
            step = np.where(accepted[:, None], step + bend / 2, step)
        trial = u[live].copy()
        trial[:, problem.open] += step / d
        with np.errstate(all="ignore"):
            new = residuals(trial, live)
            now, before = (new * new).sum(axis=1), cost[live]
            told = before - ((own + np.einsum("smk,sk->sm", j, step)) ** 2).sum(axis=1)
            ratio = np.where(told > 0, (before - now) / np.where(told > 0, told, 1.0), 0.0)
        ratio = np.where(np.isfinite(now), ratio, -1.0)
        better = (now <= before) & accepted & np.isfinite(now)
        length = np.linalg.norm(step, axis=1)
        radius[live] = np.where(ratio < 0.25, np.minimum(r, length) / DOWN, np.where((ratio > 0.75) & (length >= 0.9 * r), UP * r, r))
        radius[live[~accepted]] = r[~accepted] / DOWN
        took = live[better]
        moved = np.abs(step[better] / d[better]) <= MOVE * (MOVE + np.abs(u[took][:, problem.open]))
        little = (before - now)[better] <= CHANGE * np.maximum(1.0, now[better])
        u[took], f[took], cost[took] = trial[better], new[better], now[better]
        # A small change counts only where the linear problem foretold none much larger.
        done[took[(little & (told[better] <= 1e3 * CHANGE * np.maximum(1.0, now[better]))) | moved.all(axis=1)]] = True
        flat = np.abs(gradient).max(axis=1) <= FLAT * np.maximum(before, FLAT)
        done[live[flat]] = True
        stuck = live[~better & (radius[live] <= 1e-14 * np.maximum(1.0, np.linalg.norm(d * u[live][:, problem.open], axis=1)))]
        done[stuck] = told[np.isin(live, stuck)] <= 1e-7 * np.maximum(1.0, cost[stuck])
        failed[stuck[~done[stuck]]] = True
    p, _ = problem.bounded.bound(u)
    return p, np.where(np.isfinite(cost), cost, np.inf), done & ~failed
