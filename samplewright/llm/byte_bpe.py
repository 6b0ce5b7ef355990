"""Byte-level BPE: encoding to ids and decoding back.

A text is cut by the vocabulary's pattern. The first tier is a minimal perfect
hash of all vocabulary entries (hash, displace): a pre-token that is an entry is
resolved at once, as each entry's own merges lead back to it. Misses go to the
second tier, a heap of mergeable neighbours over bytes in a doubly linked list.
Workers keep resolved pre-tokens in a cache of fixed size that is emptied when
full, so memory stays bounded for any input.

Defined results. Null and empty texts have no ids and decode to no bytes. Texts
of any length are encoded whole. Rows are independent, so repeated rows, ties
and further columns need no rule; an empty table gives an empty table. Strings
of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CACHE_SIZE = 1 << 18


class PerfectHash:
    """Minimal perfect hash of byte strings: bucket, then a displacement per bucket.

    Large buckets choose their displacement first; a bucket of one key takes a
    free place outright, kept as a negative displacement.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // 2)
        parts = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        bucket = (parts % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if n else []
        self.seeds = [0] * self.buckets
        self.slots: list[int] = [-1] * n
        taken = np.zeros(n, bool)
        free = list(range(n))
        for group in sorted(groups, key=len, reverse=True):
            mixed = [int(x) for x in parts[group]]
            if len(mixed) == 1:
                places = [free.pop()]
                while taken[places[0]]:
                    places = [free.pop()]
            seed = -places[0] - 1 if len(mixed) == 1 else 0
            while len(mixed) > 1:
                places = [self._place(h, seed) for h in mixed]
                if len(set(places)) == len(places) and not taken[places].any():
                    break
                seed += 1
            self.seeds[int(bucket[group[0]])] = seed
            taken[places] = True
            for k, at in zip(group.tolist(), places, strict=True):
                self.slots[at] = k
        self.keys = keys

    def _place(self, h: int, seed: int) -> int:
        if seed < 0:
            return -seed - 1
        return ((h ^ (seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF) % self.size

    def find(self, key: bytes) -> int:
        """The key's index, or -1 if it isn't one of the keys."""
        h = xxhash.xxh64_intdigest(key)
        k = self.slots[self._place(h, self.seeds[h % self.buckets])]
        return k if self.keys[k] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked pair merges first, leftmost of equals."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    # Part i spans bytes i to after[i]; before[i] is the part to its left.
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    dead = [False] * n
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if dead[i] or j >= n or after[j] != end:
            continue  # one of the two has changed since
        after[i] = end
        dead[j] = True
        if end < n:
            before[end] = i
            if (r := get(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (k := before[i]) >= 0 and (r := get(piece[k:end])) is not None:
            heappush(heap, (r, k, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Resolved(dict):
    """Pre-token to ids, filled on demand and emptied when full."""

    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= CACHE_SIZE:
            self.clear()
        piece = token.encode("utf-8", "surrogatepass")
        k = self.coder.index.find(piece)
        ids = (self.coder.ids[k],) if k >= 0 else tuple(merged(piece, self.coder.ranks))
        if len(token) <= 64:
            self[token] = ids
        return ids


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        keys = list(self.ranks)
        self.ids = list(self.ranks.values())
        self.index = PerfectHash(keys)
        self.entries = dict(zip(self.ids, keys, strict=True))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.resolved = _Resolved(self)

    def encode(self, text: str) -> np.ndarray:
        """A text's ids as little-endian unsigned 32-bit integers."""
        resolved = self.resolved
        out: list[int] = []
        for token in self.pattern.findall(text):
            out += resolved[token]
        return np.array(out, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        entries = self.entries
        return b"".join([entries[k] for k in ids.tolist()])


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The coder of a file, built once in each worker."""
    return Coder(path)


def encoded(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """keep, then ids (array of int) of each text."""
    on_workers(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path)
        for texts in batches:
            yield pd.Series([own.encode(t).astype(np.int32) for t in texts], dtype=object)

    return df.select(*keep, ids_of(F.coalesce(F.col(text), F.lit(""))).alias("ids"))


def decoded(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """keep, then the bytes of each array of ids."""
    on_workers(df.sparkSession)

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path)
        for rows in batches:
            yield pd.Series([own.decode(np.asarray(r)) for r in rows], dtype=object)

    return df.select(*keep, bytes_of(ids).alias("bytes"))


def digests(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """keep, then n_tokens and digests of the ids and of what they decode to.

    Encodes and decodes in one pass, so that ids don't travel.
    """
    on_workers(df.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for texts in batches:
            rows = []
            for t in texts:
                ids = own.encode(t)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(*keep, of(F.coalesce(F.col(text), F.lit(""))).alias("_d")).select(*keep, "_d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: number and digests of every document's ids."""
    return digests(table(spark, sf_dir, "documents"))
