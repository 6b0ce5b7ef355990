"""Near copies by words: texts that share 0.8 or more of their 5-word shingles.

Candidates come from SimHash first: fingerprints within NEAR bits of each other
are found by their anchors, as in op5, and a class of linked ones is a key. Texts
at 0.8 may lie ten bits apart, though, far outside any radius whose anchors can be
counted out. For these, min-hashes give further keys: BANDS of ROWS smallest
shingle hashes each; a pair at 0.8 shares none of them once in 40,000. Every
candidate, of either kind, is then held against the exact Jaccard similarity of
the shingle sets before it links.

Texts with the same words are one node. Of each key, first every node is held
against the smallest one. Keys whose nodes are connected by then are done; the
others are compared across components within a task, which gives out a forest of
the links, not pairs; there a count of equal min-hashes comes before the exact
check.

Keys of more than WIDE nodes come from passages that many texts share. Their
nodes are keyed anew by their rarest shingles, as many as a text alike to 0.8
must share at least one of (|x| - 0.8 |x| + 1 of them, in one order for all, the
passages' shingles last). That loses no link, and texts which only share the
passage don't meet. Nodes that make up a wide key even then are compared in
blocks of WIDE, two at a time, each two in a task of their own; so a task holds
two blocks at most, whatever the key's size, and nothing is dropped.

Defined results. Words are separated by ASCII white space and lower-cased in
ASCII. Fewer than WIDTH words are one shingle; null, empty and blank texts are
one node. Nodes are known by a 64-bit hash of their words. A null id counts as
larger than all others. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_spread, on_workers, written
from .simhash import SEED, components, fingerprint, near_duplicates

WIDTH, LEAST = 5, 0.8
#: Bits in which linked fingerprints may differ.
NEAR = 2
BANDS, ROWS = 20, 4
#: Nodes of a block, and bytes of its sets.
WIDE, CHUNK = 1024, 1 << 26
#: Shingles that come last in the order are those of more than one in COMMON occurrences, so there are no more of them than that.
COMMON = 50_000
#: Of BANDS * ROWS min-hashes as many agree for all but one in 10 million pairs at 0.8.
CLOSE = 44


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    hash_of = xxhash.xxh3_64_intdigest
    hashes = [hash_of(line[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64))


def point_of(text: str) -> int:
    """A hash of the words of a text."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()), SEED)


def least_hashes(found: np.ndarray) -> np.ndarray:
    """Min-hashes of a set of shingle hashes."""
    rng = np.random.default_rng((SEED, 0))
    factors = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    mixed = found ^ (found >> np.uint64(29))
    return np.array([(mixed * f >> np.uint64(16)).min() for f in factors])


def band_keys(found: np.ndarray) -> np.ndarray:
    """Keys of a set of shingle hashes."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = least_hashes(found)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _set(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, np.uint64)


class Sets:
    """How stored sets of shingle hashes are compared; other kinds of stored things have classes of their own."""

    similarity = staticmethod(lambda a, b: jaccard(_set(a), _set(b)))

    @staticmethod
    def forest(rows: list[tuple], least: float, apart: bool) -> Iterator[tuple[int, int]]:
        return _forest(rows, least, apart)

    @staticmethod
    def keyed_anew(wide: DataFrame, sets: DataFrame, least: float) -> DataFrame:
        """(key, point, component) of nodes of wide keys (key, point, component): by the shingles of which alike ones share one at least."""
        inside = written(wide.select("point", "component").distinct().join(sets.select("point", "found"), "point"))

        @F.pandas_udf("array<long>")
        def all_of(stored: pd.Series) -> pd.Series:
            return pd.Series([_set(s).view(np.int64) for s in stored], dtype=object)

        counts = written(inside.select(F.explode(all_of("found")).alias("h")).groupBy("h").agg(F.count("*").alias("n")))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        common = counts.where(F.col("n") > max(1, total // COMMON)).orderBy("n", "h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
        sent = inside.sparkSession.sparkContext.broadcast(common)  # COMMON numbers at most

        @F.pandas_udf("array<long>")
        def rarest(stored: pd.Series) -> pd.Series:
            return pd.Series([prefix(_set(s), sent.value, least).view(np.int64) for s in stored], dtype=object)

        return inside.select(F.explode(rarest("found")).alias("key"), "point", "component")


def prefix(found: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set in the order of all: those that aren't common by their hashes, then common ones as they stand there.

    Two sets of that similarity share at least least * |x| shingles of either, so
    not all of them are behind these in both.
    """
    n = len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1
    order = np.argsort(common, kind="stable")
    at = np.minimum(np.searchsorted(common, found, sorter=order), max(len(common) - 1, 0))
    hit = common[order[at]] == found if len(common) else np.zeros(len(found), bool)
    last = found[hit][np.argsort(order[at[hit]], kind="stable")] if hit.any() else found[:0]
    return np.concatenate([found[~hit], last])[: max(n, 0) if len(found) else 0]


def _verified(pairs: DataFrame, sets: DataFrame, kind: type, least: float) -> DataFrame:
    """pairs (x, y) with a similarity of least or more; sets (point, found)."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([kind.similarity(x, y) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    x, y = (sets.select(F.col("point").alias(n), F.col("found").alias(f"_{n}")) for n in "xy")
    return written(pairs.join(x, "x").join(y, "y").where(alike("_x", "_y")).select("x", "y"))


def _forest(rows: list[tuple], least: float, apart: bool) -> Iterator[tuple[int, int]]:
    """Links that connect what is alike among the rows (point, component, found, least hashes, block) of a key; of different blocks only, if apart."""
    label = np.unique([r[1] for r in rows], return_inverse=True)[1]
    digits = np.stack([np.frombuffer(r[3], np.uint8) for r in rows])
    size, block = np.array([len(r[2]) for r in rows], float), np.array([r[4] for r in rows])
    for k in range(len(rows) - 1):
        far = (label[k + 1 :] != label[k]) & (np.minimum(size[k + 1 :], size[k]) >= least * np.maximum(size[k + 1 :], size[k]) - 1e-6)
        near = np.flatnonzero(far & (block[k + 1 :] != block[k]) if apart else far) + k + 1
        for j in near[(digits[near] == digits[k]).sum(axis=1) >= CLOSE].tolist():
            if label[j] != label[k] and jaccard(_set(rows[k][2]), _set(rows[j][2])) >= least:
                label[label == label[j]] = label[k]
                yield rows[k][0], rows[j][0]


def _compare(batches: Iterator[pd.DataFrame], kind: type, least: float) -> Iterator[pd.DataFrame]:
    """Links from rows sorted by key and its two blocks; rows of one key may span batches."""
    key, held = None, []
    for batch in batches:
        out = []
        for *k, point, component, found, digits, block in zip(*(batch[c] for c in ("key", "a", "b", "point", "component", "found", "digits", "block")), strict=True):
            if k != key:
                out += kind.forest(held, least, key[1] != key[2]) if held else []
                key, held = k, []
            held.append((point, component, found, digits, block))
        yield pd.DataFrame(out, columns=["x", "y"], dtype="int64")
    if held:
        yield pd.DataFrame(list(kind.forest(held, least, key[1] != key[2])), columns=["x", "y"], dtype="int64")


def _shared(keyed: DataFrame) -> DataFrame:
    """keyed (key, point, component, bytes), stored, of keys with more than one component, with head, n and the key's bytes."""
    per_key = keyed.groupBy("key").agg(
        F.min("point").alias("head"), F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"), F.min("component").alias("_low"), F.max("component").alias("_high")
    )
    per_key = written(per_key.where("_low < _high").select("key", "head", "n", "all_bytes", F.col("n").alias("_rows")))
    return joined_spread(keyed, per_key, ["key"])


def _compared(open_: DataFrame, sets: DataFrame, kind: type, least: float) -> DataFrame:
    """(x, y): links between components of shared keys, in blocks two at a time."""
    blocks = F.greatest(F.ceil(F.col("n") / WIDE), F.ceil(F.col("all_bytes") / CHUNK)).cast("int")
    rows = open_.select("key", "point", "component", F.pmod(F.xxhash64("point", F.lit(7)), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    rows = rows.select("key", F.least("block", "_other").alias("a"), F.greatest("block", "_other").alias("b"), "point", "component", "block")
    rows = rows.join(sets.select("point", "found", "digits"), "point").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return written(rows.mapInPandas(lambda batches: _compare(batches, kind, least), "x long, y long").distinct())


def links(keyed: DataFrame, sets: DataFrame, least: float = LEAST, kind: type = Sets) -> DataFrame:
    """keyed (key, point) and sets (point, found, digits), both stored, to (x, y): enough links to connect all that are alike and share a key."""
    on_workers(keyed.sparkSession)
    sizes = sets.select("point", F.octet_length("found").cast("long").alias("bytes"))
    keyed = written(keyed.join(sizes, "point"))
    alone = _shared(keyed.withColumn("component", F.col("point")))
    starred = _verified(alone.where("point != head").select(F.col("point").alias("x"), F.col("head").alias("y")).distinct(), sets, kind, least)
    nodes = sets.select("point", F.col("point").alias("low"))
    known = components(nodes, starred).select("point", "component")
    keyed = written(keyed.join(known, "point", "left").select("key", "point", F.coalesce("component", "point").alias("component"), "bytes"))
    open_ = written(_shared(keyed))
    wide = open_.where(F.col("n") > WIDE)
    found = _compared(open_.where(F.col("n") <= WIDE), sets, kind, least)
    if wide.limit(1).count():
        anew = written(kind.keyed_anew(wide.select("key", "point", "component"), sets, least).distinct().join(sizes, "point"))
        found = found.unionByName(_compared(written(_shared(anew)), sets, kind, least))
    return starred.unionByName(found)


def fingerprint_keys(nodes: DataFrame, threshold: int = NEAR) -> DataFrame:
    """nodes (point, print) to (key, point): the class of fingerprints linked by op5's anchors, where it has more than one node."""
    classes = written(near_duplicates(nodes.select(F.col("point").alias("node"), F.col("print").alias("point")), threshold, "node").select("class", "node"))
    several = classes.groupBy("class").agg(F.count("*").alias("_rows")).where("_rows > 1")
    return joined_spread(classes, written(several), ["class"]).select(F.col("class").alias("key"), F.col("node").alias("point"))


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """df with one row of each group of near copies left: the one with the smallest id, then hash.

    Rows are known by two hashes of id and text; of wholly equal rows one stays.
    """
    on_workers(df.sparkSession)

    @F.pandas_udf("point long, print long, keys array<long>")
    def read(texts: pd.Series) -> pd.DataFrame:
        points, prints = (np.array([f(t) for t in texts], np.uint64).view(np.int64) for f in (point_of, fingerprint))
        return pd.DataFrame({"point": points, "print": prints, "keys": [band_keys(shingles(t)) for t in texts]})

    @F.pandas_udf("found binary, digits binary")
    def stored(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({"found": [s.tobytes() for s in sets], "digits": [least_hashes(s).astype(np.uint8).tobytes() for s in sets]})

    key = [F.xxhash64(id, text).alias("_k"), F.hash(id, text).alias("_k2")]
    rows = written(df.select(F.col(id).alias("_id"), *key, read(F.coalesce(F.col(text), F.lit(""))).alias("_r")).select("_id", "_k", "_k2", "_r.*"))
    best = F.min(F.struct(F.coalesce("_id", F.lit(2**63 - 1)).alias("low"), "_k", "_k2")).alias("best")
    nodes = written(rows.groupBy("point").agg(best, F.first("print").alias("print")))
    keyed = rows.select(F.explode("keys").alias("key"), "point").distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = written(keyed.join(shared, "key").unionByName(fingerprint_keys(nodes)).distinct())
    leads = nodes.join(keyed.select("point").distinct(), "point", "left_semi").select("point", "best._k", "best._k2")
    sets = df.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(leads, ["_k", "_k2"])
    sets = written(sets.select("point", stored("_text").alias("_s")).select("point", "_s.*").dropDuplicates(["point"]))
    found = components(nodes.select("point", "best.low"), links(keyed, sets, least)).select("point", "class")
    classed = nodes.join(found, "point", "left").select(F.coalesce("class", "point").alias("class"), "best")
    lead = written(classed.groupBy("class").agg(F.min("best").alias("best")).select("best._k", "best._k2"))
    same = W.partitionBy("_k", "_k2").orderBy(F.lit(0))
    # One struct for all columns: no names clash with these.
    kept = df.select(F.struct("*").alias("_d"), *key).join(lead, ["_k", "_k2"], "left_semi")
    return kept.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").select("_d.*")
