"""Near-duplicates by SimHash with anchor-point covering.

Fingerprints are 64-bit majorities of shingle hashes. Two of them link at
`threshold` or fewer differing bits. As anchors serve the words of a perfect
covering code: the Hamming code of length 63 times one free bit. Every point of
the space lies within one bit of an anchor (covering radius 1). Two linked
fingerprints have a midpoint within half the threshold of both; the anchor next
to that midpoint is therefore within covering radius plus that half of both. So
each distinct fingerprint is replicated to every such anchor (33 at most for
threshold 2) and compared only with those that share an anchor.

An anchor's ball holds a fixed number of points (some 4,000 for threshold 2),
so no group grows with the input, however many near copies there are. Exact
copies share a fingerprint and are one node. Per anchor a spanning forest of the
links leaves the task, not all pairs; labels then spread along the links until
nothing changes, with pointer jumps, each round written to the shared folder.

Defined results. Null, empty and blank texts have fingerprint zero and link like
any other. Repeated rows share a class. A null id counts as larger than all
others; a class of null ids only has a null id. An empty table gives an empty
table. Only the id and the text are read, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_spread, on_workers, table, written

SEED = 42
#: Runs of up to this many fingerprints of an anchor are compared all at once.
SHORT = 8


def fingerprint(text: str, width: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = len(words) - width + 1
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(line[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_ = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3):
    """A column with each text's fingerprint as a (signed) long."""
    on_workers(df.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return of(F.coalesce(F.col(text), F.lit("")))


def _syndrome(points: np.ndarray) -> np.ndarray:
    """Of the lower 63 bits: the exclusive or of the places (1 to 63) that are set."""
    out = np.zeros(len(points), np.uint64)
    for k in range(6):
        mask = sum(1 << (place - 1) for place in range(1, 64) if place >> k & 1)
        out |= (np.bitwise_count(points & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


def _nearest(points: np.ndarray) -> np.ndarray:
    """The one anchor within a bit: the code word for 63 bits, the free bit as it is."""
    s = _syndrome(points)
    flip = np.where(s > 0, np.uint64(1) << ((s - np.uint64(1)) & np.uint64(63)), np.uint64(0))
    return points ^ flip


def anchors_of(points: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, point) with the anchor nearest to a point within ceil(threshold / 2)."""
    half = (threshold + 1) // 2
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    grid = np.stack([_nearest(points ^ np.uint64(m)) for m in masks], axis=1)
    grid.sort(axis=1)
    fresh = np.ones(grid.shape, bool)
    fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
    return grid[fresh], np.repeat(points, fresh.sum(axis=1))


def _forest(points: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Each point of an anchor that is linked to a smaller one, with its smallest."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= threshold
    label = np.arange(len(points))
    while True:
        low = np.where(near, label[None, :], len(points)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def _compare(batches: Iterator[pd.DataFrame], threshold: int) -> Iterator[pd.DataFrame]:
    """Links from rows sorted by anchor; an anchor's rows may span batches."""
    held = np.zeros((0, 2), np.int64)

    def links(rows: np.ndarray) -> pd.DataFrame:
        anchor = rows[:, 0]
        point = np.ascontiguousarray(rows[:, 1]).view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(rows) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(rows)))
        some = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
        a, p = anchor[some], point[some]
        found = []
        for lag in range(1, SHORT):
            hit = (a[lag:] == a[:-lag]) & (np.bitwise_count(p[lag:] ^ p[:-lag]) <= threshold)
            found.append((p[lag:][hit], p[:-lag][hit]))
        for k in np.flatnonzero(sizes > SHORT):
            found.append(_forest(point[starts[k] : starts[k] + sizes[k]], threshold))
        x, y = (np.concatenate(c) if found else np.zeros(0, np.uint64) for c in zip(*found, strict=True))
        return pd.DataFrame({"x": x.view(np.int64), "y": y.view(np.int64)}).drop_duplicates()

    for batch in batches:
        rows = np.concatenate([held, batch[["anchor", "point"]].to_numpy(np.int64)])
        if not len(rows):
            continue
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        held = rows[cut:]
        if cut:
            yield links(rows[:cut])
    if len(held):
        yield links(held)


def links(points: DataFrame, threshold: int = 2) -> DataFrame:
    """points (point long, distinct) to (x, y): a forest of the links at each anchor."""
    on_workers(points.sparkSession)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_ = batch["point"].to_numpy(np.int64).view(np.uint64)
            for part in np.array_split(all_, max(1, len(all_) // 2048)):
                anchor, point = anchors_of(part, threshold)
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "point": point.view(np.int64)})

    spread_out = points.select("point").mapInPandas(spread, "anchor long, point long")
    return (
        spread_out.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInPandas(lambda batches: _compare(batches, threshold), "x long, y long")
        .distinct()
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (point, low), edges (x, y) to (point, component, class) of linked points.

    component is the smallest low within reach, class the point that has it. A
    round takes the smallest label among neighbours, then jumps to that label's
    own label.
    """
    both = edges.select(F.col("x").alias("point"), F.col("y").alias("near"))
    both = written(both.unionByName(both.select(F.col("near").alias("point"), F.col("point").alias("near"))).distinct())
    own = F.struct(F.coalesce("low", F.lit(2**63 - 1)).alias("low"), F.col("point").alias("at"))
    linked = nodes.join(both.select("point").distinct(), "point", "left_semi")
    labels = written(linked.select("point", own.alias("label"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        heard = both.join(labels.select(F.col("point").alias("near"), "label"), "near").groupBy("point").agg(F.min("label").alias("heard"))
        stepped = labels.select("point", "label").join(heard, "point").select("point", "label", F.least("label", "heard").alias("low"))
        there = labels.select(F.col("point").alias("at"), F.col("label").alias("jump"))
        labels = written(
            stepped.withColumn("at", F.col("low.at"))
            .join(there, "at")
            .select("point", F.least("low", "jump").alias("label"), (F.least("low", "jump") != F.col("label")).alias("moved"))
        )
    return labels.select("point", F.nullif("label.low", F.lit(2**63 - 1)).alias("component"), F.col("label.at").alias("class"))


def near_duplicates(rows: DataFrame, threshold: int = 2, id: str = "doc_id") -> DataFrame:
    """rows (id, point, ...) to the same rows with component_id and class (a point)."""
    nodes = written(rows.groupBy("point").agg(F.min(id).alias("low"), F.count("*").alias("_rows")))
    found = components(nodes, written(links(nodes, threshold)))
    lone = F.col("class").isNull()
    classes = nodes.join(found, "point", "left").select(
        "point", F.when(lone, F.col("low")).otherwise(F.col("component")).alias("component_id"), F.coalesce("class", "point").alias("class"), "_rows"
    )
    # A third of all rows may be copies of one text, or empty.
    return joined_spread(rows, written(classes), ["point"])


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, threshold: int = 2) -> DataFrame:
    """df with one row of each class left: the one with the smallest id, then hash.

    Rows are known by two hashes of id and text; of wholly equal rows one stays.
    """
    key = [F.xxhash64(id, text).alias("_k"), F.hash(id, text).alias("_k2")]
    rows = written(df.select(F.col(id).alias("_id"), *key, fingerprints(df, text, width).alias("point")))
    classes = near_duplicates(rows, threshold, "_id")
    best = F.min(F.struct(F.coalesce("_id", F.lit(2**63 - 1)), "_k", "_k2")).alias("best")
    lead = written(classes.groupBy("class").agg(best).select("best._k", "best._k2"))
    same = W.partitionBy("_k", "_k2").orderBy(F.lit(0))
    # One struct for all columns: no names clash with these.
    kept = df.select(F.struct("*").alias("_d"), *key).join(lead, ["_k", "_k2"], "left_semi")
    return kept.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").select("_d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprint and class of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = written(docs.select("doc_id", fingerprints(docs).alias("point")))
    return near_duplicates(rows).select("doc_id", F.lpad(F.lower(F.hex("point")), 16, "0").alias("fingerprint"), "component_id")
