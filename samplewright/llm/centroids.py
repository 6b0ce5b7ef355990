"""Centroid clustering in whole numbers, with Drake's adaptive bounds.

Every vector keeps, beside its centroid, an upper bound of the distance to it,
lower bounds of the distances to its several nearest other centroids, and one
remainder bound for all the rest. When centroids move, the bounds move by as
much. A vector whose upper bound lies below all its lower bounds keeps its
centroid and no distance is computed. Else its own distance is computed, then
those of the listed centroids that aren't certainly farther, and if the
remainder bound can't certify that the rest are, those of all centroids. How many
centroids are listed falls from round to round to what was needed.

Distances are compared as whole numbers, so ties go to the smaller number
exactly; bounds are floats that are rounded away from certainty by more than
their error. Components beyond +-EXACT are computed with integers of any size.

A round is one pass over the stored vectors: it writes them with their new
bounds, and each task adds one row a centroid with the sums of its vectors, so no
centroid's vectors ever meet in a task. Only those sums, k rows added up by
Spark, come to the driver. A round's table is dropped once the next is written.

Defined results. Vectors that are null, of another length, or hold null, NaN or
infinite components are left out. Rows count each on its own, repeated ids and
vectors too. Centroids start from ids' hashes; of equal ids the smaller vector
comes first, null ids come last. With fewer vectors than k there are fewer
centroids. Sums of distances beyond a long are null. An empty table gives an
empty table. Only the id and the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, on_workers, table, written

DIMENSIONS, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Components up to this give squared distances below 2**53, exact in floats.
EXACT = 2**20
#: By how much bounds are widened; far above the rounding of a root and a sum.
SLACK = 2.0**-48
#: Whole numbers of any size are added up in digits of so many bits.
DIGIT = 24
_PART = "struct<centroid int, digit int, n long, sums array<long>, listed int, distances long>"


def components(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each x, as floats if all are within EXACT, else as Python's integers."""
    whole = np.floor(scale * values)
    if (np.abs(whole) <= EXACT).all():
        return whole
    exact = lambda x: int(np.floor(scale * x)) if abs(x) < 2**40 else int(x) * scale  # noqa: E731  beyond, x is whole
    return np.array([[exact(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors and centroids, row by row, exactly."""
    return ((vectors - centroids) ** 2).sum(axis=1)


def _root(d: np.ndarray, way: int) -> np.ndarray:
    """A bound of the root: from below (-1) or above (1)."""
    return np.sqrt(d.astype(float)) * (1 + way * SLACK)


class Bounds:
    """Bounds of some vectors: nearest centroid, its upper bound, the listed others with lower bounds, the rest's bound."""

    def __init__(self, nearest: np.ndarray, upper: np.ndarray, listed: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.nearest, self.upper, self.listed, self.lower, self.rest = nearest, upper, listed, lower, rest
        #: Listed centroids that were needed, and distances that were computed.
        self.needed, self.distances = 0, 0

    @classmethod
    def unknown(cls, n: int, k: int, width: int) -> Bounds:
        """Bounds that certify nothing."""
        width = min(width, k - 1)
        listed = np.tile(np.arange(1, width + 1), (n, 1)).reshape(n, width)
        return cls(np.zeros(n, int), np.full(n, np.inf), listed, np.zeros((n, width)), np.zeros(n) if width < k - 1 else np.full(n, np.inf))

    def moved(self, by: np.ndarray) -> None:
        """Widen the bounds by how far the centroids moved."""
        self.upper = (self.upper + by[self.nearest]) * (1 + SLACK)
        self.lower = np.maximum(0, (self.lower - by[self.listed]) * (1 - SLACK))
        self.rest = np.maximum(0, (self.rest - by.max(initial=0)) * (1 - SLACK))

    def narrowed(self, width: int) -> None:
        """List the nearest `width` others only."""
        if width < self.listed.shape[1]:
            order = np.argsort(self.lower, axis=1, kind="stable")
            self.listed, self.lower = np.take_along_axis(self.listed, order, 1), np.take_along_axis(self.lower, order, 1)
            self.rest = np.minimum(self.rest, self.lower[:, width:].min(axis=1))
            self.listed, self.lower = self.listed[:, :width], self.lower[:, :width]

    def assign(self, vectors: np.ndarray, centroids: np.ndarray) -> None:
        """Make every vector's nearest centroid right, the smaller number of equals."""
        least = lambda rows: np.minimum(self.lower[rows].min(axis=1, initial=np.inf), self.rest[rows])
        rows = np.flatnonzero(self.upper >= least(slice(None)))
        own = squared(vectors[rows], centroids[self.nearest[rows]])
        self.distances += len(rows)
        self.upper[rows] = _root(own, 1)
        open_ = self.upper[rows] >= least(rows)
        rows, own = rows[open_], own[open_]
        whole = self.upper[rows] >= self.rest[rows]
        self._listed(vectors, centroids, rows[~whole], own[~whole])
        self._all(vectors, centroids, rows[whole])

    def _listed(self, vectors: np.ndarray, centroids: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        if not len(rows):
            return
        at, place = np.nonzero(self.lower[rows] <= self.upper[rows, None])
        of, number = rows[at], self.listed[rows[at], place]
        found = squared(vectors[of], centroids[number])
        self.distances += len(found)
        self.needed = max(self.needed, int(np.bincount(at).max(initial=0)))
        self.lower[of, place] = _root(found, -1)
        best = own.copy()
        for p in range(self.listed.shape[1]):
            some = place == p
            a, d = at[some], found[some]
            nearer = (d < best[a]) | ((d == best[a]) & (number[some] < self.nearest[rows[a]]))
            a, d = a[nearer], d[nearer]
            # The two change places.
            r = rows[a]
            self.listed[r, p], self.nearest[r] = self.nearest[r], self.listed[r, p]
            self.lower[r, p], best[a] = _root(best[a], -1), d
        self.upper[rows] = _root(best, 1)

    def _all(self, vectors: np.ndarray, centroids: np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        width = self.listed.shape[1]
        found = np.stack([squared(vectors[rows], c[None, :]) for c in centroids], axis=1)
        self.distances += found.size
        order = np.argsort(found, axis=1, kind="stable")
        sorted_ = np.take_along_axis(found, order, 1)
        self.nearest[rows], self.upper[rows] = order[:, 0], _root(sorted_[:, 0], 1)
        self.listed[rows], self.lower[rows] = order[:, 1 : width + 1], _root(sorted_[:, 1 : width + 1], -1)
        self.needed = max(self.needed, width)
        if found.shape[1] > width + 1:
            self.rest[rows] = _root(sorted_[:, width + 1], -1)


def _digits(totals: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Whole numbers as (digit, its values), so that longs can add them up; digits of zeros are left out."""
    whole = [int(t) for t in totals]
    for k in range(max(1, -(-max(abs(t).bit_length() for t in whole) // DIGIT))):
        values = [(-1 if t < 0 else 1) * (abs(t) >> k * DIGIT & (1 << DIGIT) - 1) for t in whole]
        if k == 0 or any(values):
            yield k, values


def _sums(vectors: np.ndarray, nearest: np.ndarray, k: int) -> np.ndarray:
    """The sum of the vectors of each centroid."""
    out = np.zeros((k, vectors.shape[1]), object)
    for c in range(k):
        own = vectors[nearest == c]
        out[c] = [int(x) for x in own.sum(axis=0)] if len(own) else 0
    return out


def _round(centroids: list[list[int]], before: list[list[int]] | None, width: int, scale: int):
    """A round's pass over batches of vectors with their bounds; before is None in the first."""
    k = len(centroids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.array(centroids, object)
        floats = here.astype(float) if max((abs(x) for c in centroids for x in c), default=0) <= EXACT else None
        there = np.zeros(k) if before is None else np.array([float(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(centroids, before, strict=True)])
        by = _root(there, 1)
        sums, n, needed, distances = np.zeros((k, len(centroids[0])), object), np.zeros(k, np.int64), 0, 0
        kind = None
        for batch in batches:
            kind = batch.schema.field("vector").type
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            vectors = components(values, scale)
            exact = vectors.dtype == object or floats is None
            vectors, middle = (vectors.astype(object), here) if exact else (vectors, floats)
            if exact and vectors.size and not isinstance(vectors[0, 0], int):
                vectors = np.array([[int(x) for x in row] for row in vectors], object)
            if before is None:
                bounds = Bounds.unknown(batch.num_rows, k, width)
            else:
                grid = lambda name, dtype: batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, -1)  # noqa: B023, E731
                one = lambda name, dtype: batch.column(name).to_numpy(zero_copy_only=False).astype(dtype)  # noqa: B023, E731
                bounds = Bounds(one("nearest", int), one("upper", float), grid("listed", int), grid("lower", float), one("rest", float))
                bounds.moved(by)
                bounds.narrowed(width)
            bounds.assign(vectors, middle)
            own = squared(vectors, middle[bounds.nearest])
            sums += _sums(vectors, bounds.nearest, k)
            n += np.bincount(bounds.nearest, minlength=k)
            needed, distances = max(needed, bounds.needed), distances + bounds.distances
            fits = [int(d) if d < 2**63 else None for d in own.tolist()]
            lists = lambda x, t: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), t), x.shape[1]).cast(pa.list_(t)) if x.shape[1] else pa.array([[]] * len(x), pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("vector"), pa.array(bounds.nearest, pa.int32()), pa.array(bounds.upper), lists(bounds.listed, pa.int32()), lists(bounds.lower, pa.float64()),
                    pa.array(bounds.rest), pa.array(fits, pa.int64()), pa.nulls(batch.num_rows, _part_type()),
                ],
                _STATE,
            )
        if kind is not None:
            rows = [{"centroid": c, "digit": d, "n": int(n[c]) if d == 0 else 0, "sums": v, "listed": needed, "distances": distances if c == d == 0 else 0} for c in range(k) for d, v in _digits(sums[c])]
            empty = [pa.nulls(len(rows), t) for t in (pa.int64(), kind, pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(rows, _part_type())], _STATE)

    return of


_STATE = ["id", "vector", "nearest", "upper", "listed", "lower", "rest", "distance", "part"]


def _part_type() -> pa.DataType:
    return pa.struct([("centroid", pa.int32()), ("digit", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("listed", pa.int32()), ("distances", pa.int64())])


def starting(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors of the k ids with the smallest hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.orderBy(F.asc_nulls_last(hashed), "vector").limit(k).select(F.col("vector").cast("array<double>").alias("vector")).collect()
    return [[int(x) for x in components(np.array([r["vector"]]), scale)[0]] for r in rows]


def _next(centroids: list[list[int]], parts: DataFrame) -> tuple[list[list[int]], int, int]:
    """The centroids after a round, how many listed ones it needed, how many distances it computed."""
    d = len(centroids[0])
    rows = parts.groupBy("centroid", "digit").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"), F.max("listed").alias("listed"), F.sum("distances").alias("distances")
    ).collect()
    n, total = [0] * len(centroids), [[0] * d for _ in centroids]
    for r in rows:
        n[r["centroid"]] += r["n"]
        total[r["centroid"]] = [t + (s << r["digit"] * DIGIT) for t, s in zip(total[r["centroid"]], r["sums"], strict=True)]
    moved = [[t // m for t in own] if m else c for own, m, c in zip(total, n, centroids, strict=True)]
    return moved, max((r["listed"] for r in rows), default=0), sum(r["distances"] for r in rows)


def clustered(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, width: int | None = None
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """Rows (id, cluster, distance) of the vectors that count, the final centroids, and the distances computed in each round.

    width: centroids listed at first, half of the others by default.
    """
    on_workers(df.sparkSession)
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(F.col(id).cast("long").alias("id"), v.alias("vector")).where(F.coalesce((F.size("vector") == dimensions) & finite, F.lit(False)))
    centroids = starting(kept, k, seed, scale)
    kind = kept.schema["vector"].dataType.simpleString()
    if not centroids:
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], []
    schema = f"id long, vector {kind}, nearest int, upper double, listed array<int>, lower array<double>, rest double, distance long, part {_PART}"
    width = max(1, len(centroids) // 2) if width is None else width
    state, before, computed = kept, None, []
    for round_ in range(rounds + 1):
        passed = written(state.mapInArrow(_round(centroids, before, width, scale), schema))
        if before is not None:
            dropped(state_table)
        state_table, state, before = passed, passed.where("part IS NULL").drop("part"), centroids
        moved, needed, distances = _next(centroids, passed.where("part IS NOT NULL").select("part.*"))
        computed.append(distances)
        if round_ < rounds:
            centroids = moved
            # In the first round all are needed, as nothing is known.
            width = width if round_ == 0 else max(1, len(centroids) // 8, min(width, needed))
    return state.select("id", F.col("nearest").alias("cluster"), "distance"), centroids, computed


def described(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows with cluster_inertia, inertia and the centroid's digest."""
    spark = rows.sparkSession
    by = {r["cluster"]: r["total"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("lost")).where("lost = 0").collect()}
    long = lambda x: int(x) if x is not None and x < 2**63 else None
    whole = long(sum(by.values())) if len(by) == rows.select("cluster").distinct().count() else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(c, long(by.get(c)), whole, h) for c, h in enumerate(digest)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster")  # a row a centroid


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: cluster and distance of every vector."""
    rows, centroids, _ = clustered(table(spark, sf_dir, "embeddings"))
    return described(rows, centroids).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """DuckDB SQL of op11, all distances in every round."""
    steps = []
    for t in range(ROUNDS + 1):
        steps.append(
            f"""d{t} AS MATERIALIZED (SELECT r, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{t} m USING (i) GROUP BY r, c),
    a{t} AS MATERIALIZED (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if t < ROUNDS:
            steps.append(
                f"""s{t} AS MATERIALIZED (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{t} a JOIN v USING (r) GROUP BY a.c, v.i),
    c{t + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{t} LEFT JOIN s{t} USING (c, i))"""
            )
    return f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMENSIONS}),
    v AS MATERIALIZED (SELECT r, i, floor({SCALE} * e[i]::DOUBLE)::HUGEINT AS x FROM kept, range(1, {DIMENSIONS + 1}) t(i)),
    first AS (SELECT r, row_number() OVER (ORDER BY h, e) - 1 AS c FROM (SELECT r, e, sha256('{SEED}:' || vec_id) AS h FROM kept) QUALIFY c < {K}),
    c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN v USING (r)),
    {", ".join(steps)},
    h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
    SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{ROUNDS} JOIN kept USING (r) JOIN h USING (c)
    """
