"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at step j it puts out the character it is at
and moves on if the coin r(j, character) shows one. Texts at edit distance k end
up at a Hamming distance that depends on k alone, since walks that an edit drove
apart meet again. The fingerprint samples the walk at fixed steps, SAMPLES in
each octave of steps, so it covers texts of any length whole and its size grows
with the logarithm only; each sample is one hex digit of a hash of its place and
character. Two fingerprints' likeness estimates the share of equal steps. Bands
of samples serve as keys to find candidates, which likeness then verifies; what
is alike forms classes. Coins repeat after PERIOD steps and characters fall into
256 classes, so texts that differ only in characters of one class can't be told
apart. Ids must be whole numbers (long).

Defined results. Null and empty texts have an empty fingerprint; two of them
have likeness 1, an empty one and another 0. Equal texts have equal
fingerprints. In the order of documents null ids come last and rows of equal ids
are ordered by their texts' hash; a single document is its own next one. An empty
table gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_spread, on_workers, table, written
from .shingles import links
from .simhash import components

#: Likeness from which fingerprints link.
LEAST = 0.8
SEED, SAMPLES, PERIOD = 42, 32, 4096
OCTAVES = 40
BANDS, BAND_WIDTH = 12, 9
#: Characters read at a time, and buckets that rows without an id are dealt over.
CHUNK, NULL_BUCKETS = 1 << 20, 64


@lru_cache(maxsize=1)
def _walk() -> tuple[bytes, list[int], np.ndarray, np.ndarray]:
    """Steps a character holds the walk by (class, step), sampled steps, their weights, hash digits."""
    rng = np.random.default_rng(SEED)
    coins = rng.integers(0, 2, (256, PERIOD), dtype=np.uint8)
    coins[:, -1] = 1
    hold = np.zeros((256, PERIOD), np.uint8)
    left = np.zeros(256, np.uint8)
    for j in [*range(PERIOD - 1, -1, -1)] * 2:
        left = np.where(coins[:, j] == 1, 1, left + 1).astype(np.uint8)
        hold[:, j] = left
    at, weight = [0], [1.0]
    for k in range(OCTAVES):
        steps = np.unique(rng.integers(1 << k, 2 << k, SAMPLES)) if (1 << k) > SAMPLES else np.arange(1 << k, 2 << k)
        at += steps.tolist()
        weight += [(1 << k) / len(steps)] * len(steps)
    digits = rng.integers(0, 16, (len(at), 256), dtype=np.uint8)
    return hold.tobytes(), [*at, 1 << 62], np.array(weight), digits


class Walk:
    """A walk that can be continued, and copied where texts part."""

    def __init__(self, step: int = 0, seen: bytes = b""):
        self.step, self.seen = step, bytearray(seen)

    def copy(self) -> Walk:
        return Walk(self.step, self.seen)

    def read(self, text: str) -> Walk:
        for k in range(0, len(text), CHUNK):
            self._read(text[k : k + CHUNK])
        return self

    def _read(self, text: str) -> None:
        hold, at, _, _ = _walk()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = ((codes + 37 * (codes >> 8)) & 255).astype(np.uint8).tobytes()
        j, seen = self.step, self.seen
        target = at[len(seen)]
        for c in classes:
            j += hold[c << 12 | j & 4095]
            while j > target:
                seen.append(c)
                target = at[len(seen)]
        self.step = j

    def fingerprint(self) -> str:
        if not self.seen:
            return ""
        digits = _walk()[3]
        row = np.frombuffer(bytes(self.seen), np.uint8)
        return (digits[np.arange(len(row)), row] + np.where(digits[np.arange(len(row)), row] < 10, 48, 87)).astype(np.uint8).tobytes().decode()


def fingerprint(text: str) -> str:
    """The fingerprint of one text."""
    return Walk().read(text).fingerprint()


def likeness(a: str, b: str) -> float:
    """Estimated share of equal steps, corrected for digits that agree by chance."""
    if not a and not b:
        return 1.0
    n, most = min(len(a), len(b)), max(len(a), len(b))
    weight = _walk()[2][:most]
    same = np.frombuffer(a.encode(), np.uint8)[:n] == np.frombuffer(b.encode(), np.uint8)[:n]
    share = float((weight[:n] * same).sum() / weight.sum())
    return min(1.0, max(0.0, (share - 1 / 16) / (15 / 16)))


def with_fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then the fingerprint of each text."""
    on_workers(df.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype=object)

    return df.select(*keep, of(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))


@lru_cache(maxsize=None)
def _picks(octave: int, level: int) -> np.ndarray:
    """The samples of each band of an octave; another level has other ones."""
    ends, rng = _octave_ends(), np.random.default_rng((SEED, octave, level))
    span = int(ends[octave] - ends[octave - 1])
    return ends[octave - 1] + np.stack([rng.choice(span, min(BAND_WIDTH, span), replace=False) for _ in range(BANDS)])


def band_keys(found: bytes, level: int = 0) -> list[int]:
    """Keys from samples of the last two octaves that a walk has passed whole."""
    last = int(np.searchsorted(_octave_ends(), len(found), "right")) - 1
    digits = np.frombuffer(found, np.uint8)
    out = []
    for k in range(max(1, last - 1), last + 1):
        out += [xxhash.xxh64_intdigest(row.tobytes(), k << 8 | b) - (1 << 63) for b, row in enumerate(digits[_picks(k, level)])]
    return out or [xxhash.xxh64_intdigest(found) - (1 << 63)]


@lru_cache(maxsize=1)
def _octave_ends() -> np.ndarray:
    """Number of samples before the end of each octave."""
    at = np.array(_walk()[1][:-1])
    return np.searchsorted(at, [1 << k for k in range(OCTAVES + 1)])


class Prints:
    """How stored fingerprints are compared (see shingles.links)."""

    similarity = staticmethod(lambda a, b: likeness(bytes(a).decode(), bytes(b).decode()))

    @staticmethod
    def keyed_anew(wide: DataFrame, sets: DataFrame, least: float) -> DataFrame:
        """(key, point, component) of nodes of wide keys, dealt out by further samples within each."""

        @F.pandas_udf("array<long>")
        def deeper(stored: pd.Series) -> pd.Series:
            return pd.Series([band_keys(bytes(s), 1) for s in stored], dtype=object)

        dealt = wide.join(sets.select("point", "found"), "point").select("key", F.explode(deeper("found")).alias("_deeper"), "point", "component")
        return dealt.select(F.xxhash64("key", "_deeper").alias("key"), "point", "component")

    @staticmethod
    def forest(rows: list[tuple], least: float, apart: bool) -> Iterator[tuple[int, int]]:
        """Links that connect what is alike among rows (point, component, found, digits, block) of a key; of different blocks only, if apart."""
        block = np.array([r[4] for r in rows])
        size = np.array([len(r[2]) for r in rows], np.int64)
        digits = np.zeros((len(rows), size.max(initial=0)), np.uint8)
        for row, r in enumerate(rows):
            digits[row, : len(r[2])] = np.frombuffer(r[2], np.uint8)
        weight = _walk()[2][: digits.shape[1]]
        whole = np.concatenate(([0.0], np.cumsum(weight)))
        label = np.unique([r[1] for r in rows], return_inverse=True)[1]
        for k in range(len(rows) - 1):
            other = label[k + 1 :] != label[k]
            far = np.flatnonzero(other & (block[k + 1 :] != block[k]) if apart else other) + k + 1
            for at in range(0, len(far), 4096):
                part = far[at : at + 4096]
                share = (digits[part, : size[k]] == digits[k, : size[k]]) @ weight[: size[k]] / np.maximum(whole[np.maximum(size[part], size[k])], 1)
                for j in part[(share - 1 / 16) / (15 / 16) >= least - 1e-9].tolist():
                    if label[j] != label[k] and Prints.similarity(rows[k][2], rows[j][2]) >= least:
                        label[label == label[j]] = label[k]
                        yield rows[k][0], rows[j][0]


def near_classes(found: DataFrame, least: float = LEAST, id: str = "doc_id") -> DataFrame:
    """found (id, fingerprint, ..., stored) with near_class: the smallest id within reach of links of that likeness or more.

    Equal fingerprints are one node. Nodes that share a band are candidates, and
    every link is verified: each node against its band's smallest one by a join,
    then those that are not connected yet among each other, wide bands dealt out
    by further samples first.
    """
    on_workers(found.sparkSession)

    @F.pandas_udf("array<long>")
    def keys(rows: pd.Series) -> pd.Series:
        return pd.Series([band_keys(bytes(r)) for r in rows], dtype=object)

    rows = found.withColumn("point", F.xxhash64("fingerprint"))
    nodes = written(rows.groupBy("point").agg(F.min(id).alias("low"), F.count("*").alias("_rows"), F.first("fingerprint").cast("binary").alias("found")))
    keyed = nodes.select(F.explode(F.array_distinct(keys("found"))).alias("key"), "point")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = written(keyed.join(shared, "key"))
    sets = written(nodes.join(keyed.select("point").distinct(), "point", "left_semi").select("point", "found", F.lit(b"").alias("digits")))
    classes = components(nodes.select("point", "low"), links(keyed, sets, least, Prints))
    # A class of rows without ids has none.
    named = nodes.join(classes, "point", "left").select("point", F.when(F.col("class").isNull(), F.col("low")).otherwise(F.col("component")).alias("near_class"), "_rows")
    return joined_spread(rows, written(named), ["point"]).drop("point")


def in_order(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, tail, doc_id, text) so that within a bucket each row precedes its next document.

    Buckets are ranges of ids; the first document of each is sent along to the
    bucket before it as its tail, so no order over all rows is needed.
    """
    spark = df.sparkSession
    on_workers(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(F.col(id).cast("double").alias("i"))
    edges = np.unique(ids.approxQuantile("i", [k / parts for k in range(1, parts)], 0.25 / parts) or [0.0])

    # Some hundred edges, searched by built-in functions. Rows without an id come after all others, from large hashes to small.
    below = F.size(F.filter(F.lit([float(e) for e in edges]), lambda e: e <= F.col("doc_id").cast("double")))
    null = F.floor((F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * NULL_BUCKETS).cast("int") - NULL_BUCKETS - 1
    placed = df.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = placed.withColumn("bucket", F.when(F.col("doc_id").isNull(), null).otherwise(below))
    # One row a bucket, at most `parts` + NULL_BUCKETS + 1.
    first = placed.groupBy("bucket").agg(F.max("doc_id").alias("first"), F.max(F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).alias("hash")).orderBy("bucket").collect()
    before = {row["bucket"]: first[(k + 1) % len(first)]["bucket"] for k, row in enumerate(first)}
    heads = spark.createDataFrame([(r["bucket"], r["first"], r["hash"], before[r["bucket"]]) for r in first], "bucket int, first long, hash long, before int")
    rows = placed.join(F.broadcast(heads), "bucket")
    leads = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("doc_id").isNotNull() | (F.xxhash64("text") == F.col("hash")))
    also = F.when(leads, F.array(F.struct("bucket", F.lit(0).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))))
    rows = rows.select("doc_id", "text", F.explode(F.coalesce(also, F.array(F.struct("bucket", F.lit(0).alias("tail"))))).alias("_p"))
    rows = rows.select("_p.bucket", "_p.tail", "doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("h").desc()).drop("h")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against itself with its second half from the next document."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # bucket, id, text, walk up to the half, whole walk's fingerprint
        for batch in batches:
            out = []
            for bucket, tail, doc, t in zip(batch["bucket"], batch["tail"], batch["doc_id"], batch["text"], strict=True):
                same = held is not None and held[0] == bucket
                if tail and not same:
                    held = None
                    continue  # a further copy of the tail
                stem = len(t) - len(t) // 2
                walk = Walk().read(t[:stem])
                own = (bucket, doc, t, walk, walk.copy().read(t[stem:]).fingerprint())
                if same:
                    out.append(_row(held, t, own[4]))
                held = None if tail else own
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})

    return in_order(df, id, text).mapInPandas(compare, RESULT)


def _row(held: tuple, next_text: str, next_found: str) -> tuple:
    _, doc, t, walk, found = held
    half = len(t) // 2
    edited = t[: len(t) - half] + next_text[:half]
    edited_found = walk.read(next_text[:half]).fingerprint()
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(t), digest, found, edited_found, likeness(found, edited_found), likeness(found, next_found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprints and likeness of every document.

    Its texts' shuffle takes most of the disk the query may use; near_classes() of
    the same fingerprints would take it beyond (figures in the README).
    """
    return edited_likeness(table(spark, sf_dir, "documents"))
