"""Centroid clustering with bounds, against computing all distances."""

import importlib
from hashlib import sha256

import numpy as np
import pytest

centroids = importlib.import_module("samplewright.llm.centroids")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, part string, cluster string, distance string"


def plain(vectors, first, rounds):
    """Lloyd's rounds with all distances, in Python's integers."""
    middle = [list(map(int, c)) for c in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(middle))
    for _ in range(rounds):
        own = [nearest(v)[1] for v in vectors]
        for k in range(len(middle)):
            if members := [v for v, o in zip(vectors, own, strict=True) if o == k]:
                middle[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return [nearest(v)[::-1] for v in vectors], middle


@pytest.mark.parametrize(("seed", "k", "width", "spread"), [(1, 8, 4, 50), (2, 8, 1, 3), (3, 20, 5, 30), (4, 3, 2, 1), (5, 2, 1, 9), (6, 1, 1, 9), (7, 9, 8, 4)])
def test_bounds_never_lose_the_nearest(seed, k, width, spread):
    """Small whole numbers, so that ties and repeated vectors abound."""
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([rng.integers(-spread, spread + 1, (400, 4)) + 3 * spread * rng.integers(-1, 2, 4), rng.integers(0, 2, (50, 4)), np.zeros((20, 4), int)]).astype(float)
    middle = vectors[rng.choice(len(vectors), k, replace=False)]
    bounds, done = centroids.Bounds.unknown(len(vectors), k, width), 0
    for _ in range(12):
        bounds.needed = 0
        bounds.assign(vectors, middle)
        d = ((vectors[:, None, :] - middle[None]) ** 2).sum(-1)
        assert (bounds.nearest == d.argmin(1)).all()  # the first of equals
        assert (bounds.upper >= np.sqrt(d.min(1))).all()
        assert (bounds.lower <= np.sqrt(np.take_along_axis(d, bounds.listed, 1))).all()
        rest = np.sort(np.where((bounds.listed[:, :, None] == np.arange(k)).any(1) | (np.arange(k) == bounds.nearest[:, None]), np.inf, d), 1)
        assert (bounds.rest <= np.sqrt(rest[:, 0])).all()
        done += 1
        after = np.stack([np.floor(vectors[bounds.nearest == c].mean(0)) if (bounds.nearest == c).any() else middle[c] for c in range(k)])
        by = centroids._root(((after - middle) ** 2).sum(1), 1)
        middle = after
        bounds.moved(by)
        bounds.narrowed(max(1, k // 8, bounds.needed))
    assert bounds.distances <= 12 * k * len(vectors)
    if k >= 8:
        assert bounds.distances < 8 * k * len(vectors)


def rows(n=300, seed=5):
    rng = np.random.default_rng(seed)
    groups = rng.normal(0, 1, (5, 6))
    out = [(k, [float(x) for x in groups[k % 5] + rng.normal(0, 0.2, 6)], 0) for k in range(n)]
    # Copies hold a third of all rows; ids repeat.
    out += [(7, out[7][1], 1)] * (n // 2)
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * 5, [1.0] * 7, [1.0] * 5 + [None], [1.0] * 5 + [nan], [inf] + [1.0] * 5, [1.0] * 5 + [-inf]]
    return [*out, *((1000 + k, b, 2) for k, b in enumerate(bad)), (None, [0.5] * 6, 3), (None, [-0.5] * 6, 3)]


def checked(spark, data, k=8, rounds=4, scale=1024, **more):
    df = spark.createDataFrame([(*r, *["c"] * 5) for r in data], SCHEMA)
    got, middle, computed = centroids.clustered(df, k=k, rounds=rounds, dimensions=6, scale=scale, **more)
    kept = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) if abs(x) < 2**40 else scale * int(np.float32(x)) for x in v]) for i, v, _ in data if v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    want, final = plain([v for _, v in kept], [v for _, v in order[:k]], rounds)
    assert middle == final
    fits = lambda d: d if d < 2**63 else None
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select("id", "cluster", "distance").collect()), key=key) == sorted(((i, c, fits(d)) for (i, _), (c, d) in zip(kept, want, strict=True)), key=key)
    return got, middle, computed


def test_clusters_are_all_distances(spark):
    got, middle, computed = checked(spark, rows())
    assert computed[-1] < computed[0]  # bounds save distances
    facts = {r["cluster"]: r for r in centroids.described(got, middle).collect()}
    by = {}
    for r in got.collect():
        by[r["cluster"]] = by.get(r["cluster"], 0) + r["distance"]
    for c, r in facts.items():
        assert (r["cluster_inertia"], r["inertia"]) == (by[c], sum(by.values()))
        assert r["centroid_sha256"] == sha256(",".join(map(str, middle[c])).encode()).hexdigest()


def test_components_of_any_size(spark):
    """A squared distance beyond a long is null, all else exact."""
    big = [(k, [1e30 * (k + 1), -3e38, 2.0**35, 0.1, -0.1, 1e-40], 0) for k in range(9)]
    got, middle, _ = checked(spark, [*rows(40), *big, (50, [3e6] * 6, 0)], rounds=3)
    assert {r["inertia"] for r in centroids.described(got, middle).collect()} <= {None}


def test_fewer_vectors_than_centroids(spark):
    checked(spark, rows(9)[:3], rounds=2)
    checked(spark, rows(9)[:1], rounds=2)
    got, middle, _ = checked(spark, [r for r in rows(9) if r[2] == 2], rounds=2)
    assert centroids.described(got, middle).collect() == []


def test_digits_add_up():
    for values in ([0, 0], [1, -1], [2**24, -(2**24) + 1], [10**41, -7], [-(2**23), 2**100]):
        total = [0] * len(values)
        for digit, some in centroids._digits(np.array(values, object)):
            assert all(abs(x) < 2**24 for x in some)
            total = [t + (x << digit * centroids.DIGIT) for t, x in zip(total, some, strict=True)]
        assert total == values
