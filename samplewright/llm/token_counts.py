"""Token counts by a map-side two-tier lookup, without any pre-token shuffle.

The first tier is a broadcast hash table of the lengths (numbers of tokens) of
the corpus's frequent pre-tokens: open addressing over 64-bit hashes, entries
checked against their bytes, so a hit is exact. They are found in a pass over all
texts: every task counts pre-tokens in a map of bounded size and gives out its
most frequent ones, some thousand rows whatever it read; these are added up and
the first FREQUENT are kept. Texts and their pre-tokens never travel. Misses go
to the worker's own cache, then to the tokenizer's merges. A text is split into
pre-tokens as the tokenizer does: special tokens first, then NFC, lower case by
character, and the vocabulary file's pattern; the end-of-word marks of the
vocabulary belong to the merges, pre-tokens have none.

Defined results. Null and empty texts have no bytes and no tokens. Whole texts
count, however long. Rows are independent: repeated rows, ties and further
columns need no rule; an empty table gives an empty table. Which pre-tokens are
in the table changes time only, never a count.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import on_workers, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
#: Entries of the frequent tier, pre-tokens that a task gives out, pre-tokens that it counts at once; none of them changes results.
FREQUENT, GIVEN, HELD = 1 << 15, 1 << 14, 1 << 17
CACHE_SIZE, CHUNK_CHARS = 1 << 18, 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Splitter:
    """Pre-tokens of a text and the number of tokens of a pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.model = Tokenizer.from_file(path).model
        self.letters = byte_letters()
        self.cache: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special tokens)."""
        parts = self.special.split(text) if "<|" in text else [text]
        out: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # By character: str.lower() alone has a rule for the last sigma of a word.
            part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))
            out += self.pattern.findall(part)
        return out, len(parts) - 1

    def length(self, token: str) -> int:
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) >= CACHE_SIZE:
                self.cache.clear()
            found = len(self.model.tokenize("".join(map(self.letters.__getitem__, token.encode("utf-8", "surrogatepass")))))
            if len(token) <= 64:
                self.cache[token] = found
        return found


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    """The splitter of a file, built once in each worker."""
    return Splitter(path)


class FrequentLengths:
    """Compact table: hashes, places of the keys in one blob, lengths."""

    def __init__(self, entries: dict[str, int]):
        keys = [k.encode("utf-8", "surrogatepass") for k in entries]
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = size - 1
        self.hashes, self.at, self.lengths = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.zeros(size, np.uint16)
        self.blob, self.bounds = b"".join(keys), np.concatenate(([0], np.cumsum([len(k) for k in keys], dtype=np.int64)))
        for k, (key, n) in enumerate(zip(keys, entries.values(), strict=True)):
            h = xxhash.xxh64_intdigest(key)
            slot = h & self.mask
            while self.at[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.hashes[slot], self.at[slot], self.lengths[slot] = h, k, n

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The length of each key, -1 for misses."""
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            at = slot[open_]
            hit = (self.at[at] >= 0) & (self.hashes[at] == h[open_])
            for k in open_[hit].tolist():
                e = self.at[slot[k]]
                if self.blob[self.bounds[e] : self.bounds[e + 1]] == keys[k]:
                    out[k] = self.lengths[slot[k]]
            open_ = open_[(self.at[at] >= 0) & (out[open_] < 0)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return out


class Tops:
    """Counts of the most frequent of a stream's words, in bounded memory.

    When more than HELD are known the rarer half goes, so a word's count can be too
    low, by less than that of the words that went each time.
    """

    def __init__(self, held: int = HELD):
        self.held, self.counts = held, Counter()

    def add(self, words: list[str]) -> None:
        self.counts.update(words)
        if len(self.counts) > self.held:
            self.counts = Counter(dict(self.counts.most_common(self.held // 2)))


def frequent(df: DataFrame, text: str = "text", path: str = VOCABULARY, entries: int = FREQUENT) -> FrequentLengths:
    """The first tier: the most frequent pre-tokens of all texts and their lengths; `entries` short rows come to the driver."""
    on_workers(df.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, tops = splitter(path), Tops()
        for batch in batches:
            for t in batch["_t"]:
                # Longer ones are no words, and would make the table large.
                tops.add([w for w in own.split(t)[0] if len(w) <= 32])
        yield pd.DataFrame(tops.counts.most_common(GIVEN), columns=["token", "n"])

    parts = df.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(of, "token string, n long")
    rows = parts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(entries).collect()
    own = splitter(path)
    return FrequentLengths({r["token"]: own.length(r["token"]) for r in rows})


def counted(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """keep, then n_bytes and n_tokens of each text."""
    spark = df.sparkSession
    on_workers(spark)
    sent = spark.sparkContext.broadcast(frequent(df, text, path))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, first = splitter(path), sent.value
        for texts in batches:
            yield pd.Series(list(chain.from_iterable(_lengths(own, first, chunk) for chunk in _chunks(texts))), dtype="int64")

    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(*keep, F.octet_length(t).cast("long").alias("n_bytes"), tokens(t).alias("n_tokens"))


def _chunks(texts: pd.Series) -> Iterator[list[str]]:
    """Some texts at a time, so that their pre-tokens fit in memory."""
    chunk, chars = [], 0
    for t in texts:
        chunk.append(t)
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def _lengths(own: Splitter, first: FrequentLengths, texts: list[str]) -> list[int]:
    split = [own.split(t) for t in texts]
    distinct = list(set(chain.from_iterable(tokens for tokens, _ in split)))
    known = first.find([t.encode("utf-8", "surrogatepass") for t in distinct])
    length = {t: n if n >= 0 else own.length(t) for t, n in zip(distinct, known.tolist(), strict=True)}
    return [sum(map(length.__getitem__, tokens)) + special for tokens, special in split]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: bytes and tokens of every document."""
    return counted(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
