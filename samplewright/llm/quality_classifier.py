"""Quality scores by nearest-neighbour voting among labelled documents.

A text becomes counts of hashed words and of hashed word shapes (letter case,
digits and signs, run lengths dropped), with steps for the shares of repeated neighbouring words and of lines.
A latent-semantic space is fitted on at most SAMPLE_ROWS labelled rows, taken by
the smallest hash of the id, never on held-out rows. Their latent vectors, a
fixed bound of SAMPLE_ROWS * RANK numbers, are sent to all tasks; every document
is compared with all of them by blocked matrix products of whole numbers, which are exact, and its
NEIGHBOURS nearest vote with weights that grow with the cosine.

Defined results. Null and empty texts have no vector and score the labels'
mean. Texts count whole, and words of any length. Repeated rows are scored each
on its own and to the same number, whatever block or partition they are in;
equally near neighbours beyond the last place are chosen by place in the sample.
Null labels are not used, of several labels of an id all are. Without labels all
scores are 0.5. An empty table gives an empty table. Only the id and text are
read, so clashing names don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, table, written

#: Bounds of the fit: labelled rows, dimensions of the latent space.
SAMPLE_ROWS, RANK = 4000, 48
EDGES = (0.05, 0.1, 0.2, 0.3, 0.5)
WORDS, SHAPES, REPEATS = 1024, 512, 2 * len(EDGES)
WIDTH = WORDS + SHAPES + REPEATS
NEIGHBOURS, POWER, THRESHOLD = 15, 8, 0.3
#: Cosines are products of these units: below 2^44, so with up to 2^18 places they fit in 63 bits.
COSINE_BITS = 22
BLOCK, CACHE_SIZE = 256, 1 << 17

_UPPER, _LOWER, _OTHER = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"(.)\1+")


def held_out(id: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class _Places(dict):
    """Token to its word and shape columns, filled on demand and emptied when full."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= CACHE_SIZE:
            self.clear()
        shape = _OTHER.sub(r"\1", _LOWER.sub("a", re.sub(r"\d+", "0", _UPPER.sub("A", token))))
        word = "".join(c for c in token.lower() if c.isalnum())
        out = (crc32(word.encode("utf-8", "surrogatepass")) % WORDS, WORDS + crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES)
        if len(token) <= 64:
            self[token] = out
        return out


_PLACES = _Places()


def counts(text: str) -> dict[int, float]:
    """Column to count for one text."""
    words = text.split()
    found = Counter(words)
    out: dict[int, float] = {}
    for token, n in found.items():
        word, shape = _PLACES[token]
        out[word] = out.get(word, 0.0) + n
        out[shape] = out.get(shape, 0.0) + n
    if found:
        lines = [x for x in text.split("\n") if x.strip()]
        # Shares of lines and of neighbouring words that repeat, by steps that add up.
        shares = (1 - len(set(lines)) / len(lines), sum(map(eq, words, words[1:])) / len(words))
        for at, share in enumerate(shares):
            for step, edge in enumerate(EDGES):
                if share > edge:
                    out[WORDS + SHAPES + at * len(EDGES) + step] = 1.0
    return out


def pack(row: dict[int, float]) -> bytes:
    """Columns and counts of a text in few bytes."""
    return np.fromiter(row, "<u2", len(row)).tobytes() + np.fromiter(row.values(), "<f8", len(row)).tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 10
    return np.frombuffer(packed, "<u2", n), np.frombuffer(packed, "<f8", n, 2 * n)


def matrix(rows: list[dict[int, float]]) -> np.ndarray:
    """Dense rows of dampened counts; one for each text."""
    out = np.zeros((len(rows), WIDTH))
    for k, row in enumerate(rows):
        out[k, list(row)] = list(row.values())
    return np.log1p(out, out=out)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _whole(x: np.ndarray, bits: int) -> np.ndarray:
    """x in units of 2^-bits. Sums of products of whole numbers below 2^53 are exact, so no order of additions shows."""
    return np.rint(np.ldexp(x, bits))


def _blocks(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = x * idf
    return _whole(np.hstack([_normal(x[:, :WORDS]), 2 * _normal(x[:, WORDS : WORDS + SHAPES]), x[:, WORDS + SHAPES :] / 2]), 14)


class Voters:
    """Labelled rows in their latent space.

    Vectors are kept in whole units, so that a cosine is the same whatever block,
    partition or machine it is computed in.
    """

    def __init__(self, rows: Iterable[dict[int, float]], labels: list[int]):
        self.labels = np.array(labels, float)
        self.mean = float(self.labels.mean()) if labels else 0.5
        if not labels:
            return
        # Rows stay packed and are spread out a block at a time: the driver's memory is small.
        packed = [pack(row) for row in rows]
        seen = np.zeros(WIDTH, np.int64)
        for columns, _ in map(unpack, packed):
            seen[columns] += 1
        self.idf = np.log1p(len(packed) / (1.0 + seen))
        blocks = range(0, len(packed), BLOCK)
        block = lambda at: _blocks(matrix([dict(zip(*map(np.ndarray.tolist, unpack(p)), strict=True)) for p in packed[at : at + BLOCK]]), self.idf)
        x = np.concatenate([block(at).astype(np.float32) for at in blocks])
        rank = min(RANK, *x.shape)
        # Truncated singular value decomposition by subspace iteration.
        basis = np.random.default_rng(42).standard_normal((WIDTH, rank)).astype(np.float32)
        for _ in range(6):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        del x
        self.basis = _whole(basis.astype(float), 20)
        self.vectors = np.concatenate([self.latent(block(at)) for at in blocks])

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of features, in units of 2^-COSINE_BITS."""
        return _whole(_normal(x @ self.basis), COSINE_BITS)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of each vector's nearest neighbours, nearest first; equally near ones by place."""
        n = len(self.labels)
        # One whole number for cosine and place: no ties are left.
        keys = (vectors @ self.vectors.T).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        k = min(NEIGHBOURS, n)
        best = -np.sort(-np.partition(keys, n - k, axis=1)[:, n - k :], axis=1)
        return n - 1 - best % n, np.ldexp((best // n).astype(float), -2 * COSINE_BITS)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Similarity-weighted mean label of each text's nearest neighbours."""
        out = np.full(len(texts), self.mean)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), BLOCK):
            rows = [counts(t) for t in texts[at : at + BLOCK]]
            near, cosines = self.nearest(self.latent(_blocks(matrix(rows), self.idf)))
            weight = np.maximum(cosines, 0) ** POWER
            total = weight.sum(axis=1)
            voted = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            some = (total > 1e-12) & np.array([bool(r) for r in rows])
            out[at : at + len(rows)][some] = voted[some]
        return out.clip(0.0, 1.0)


def fitted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> Voters:
    """Voters from at most `rows` labelled rows that are not held out."""
    on_workers(docs.sparkSession)

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(counts(t)) for t in texts], dtype=object)

    usable = labels.where(~held_out(id) & F.col(id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label"))
    # The bound is on labels; a label with several rows of its id takes one of them.
    chosen = F.broadcast(written(usable.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)))
    texts = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = texts.join(chosen, "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    got = sorted(found.select("_id", "_label", features("_text").alias("f")).collect(), key=lambda r: (r["_id"], r["_label"]))
    return Voters((dict(zip(*map(np.ndarray.tolist, unpack(bytes(r["f"]))), strict=True)) for r in got), [r["_label"] for r in got])


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", score: str = "score") -> DataFrame:
    """docs with the score as a further column."""
    spark = docs.sparkSession
    voters = spark.sparkContext.broadcast(fitted(docs, labels, id, text, label))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(voters.value.scores(texts.tolist()), dtype="float64")

    return docs.withColumn(score, of(F.coalesce(F.col(text), F.lit(""))))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that score at least the threshold, with docs' columns."""
    # One struct for all columns: no names clash with the score.
    rows = docs.select(F.struct("*").alias("_d"), F.col("doc_id"), F.col("text"))
    return scored(rows, labels).where(F.col("score") >= threshold).select("_d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: score and prediction of every document."""
    out = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
