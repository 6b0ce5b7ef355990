"""Token ids in files of range asymmetric numeral systems (rANS) with a static table.

A file is one segment of the ids of consecutive documents, as bytes (all numbers
little-endian; frequencies, offsets and states unsigned):

    magic "RNS1", then five 32-bit numbers: documents, blocks, lanes, steps from a
    checkpoint to the next, crc32 of the frequency table
    documents: ids (64 bits each), numbers of ids (64 bits each), a bit for null ids
    blocks: number of ids, number of 32-bit words, crc32 of the ids (32 bits each)
    checkpoints of all blocks in turn: lane states (64 bits each), place among
    the block's words (32 bits), one at every `checkpoint steps` steps from 0
    words of all blocks in turn

One frequency table, counted over all ids and scaled to 2**BITS, serves all
files. Blocks are independent. In a block id k belongs to lane k mod lanes; a
lane's state is pushed from the last step to the first, 32 bits leave it when it
would grow beyond 63 bits, and decoding reads the words forwards. A decoder
can start at any checkpoint, so all checkpoints of a segment are decoded side by
side, and a range of ids without those before it. Every block's checksum is
compared; a wrong one is an error.

Documents are encoded to ids once and stored; a range partitioning by id orders
them, each partition (a shard) is cut at documents into segments of about SEGMENT
ids. Files are rows of a Parquet table (shard, segment, start, n, bytes), as only
Spark's writers reach every store and leave nothing behind when an executor is
lost. Only a number a shard is summed up over all shards.

Defined results. Null texts count as empty, which have the end id only. Null ids
come first. Rows of one id, however many, are dealt over several shards; equal
ids are ordered by a hash of the ids, wholly equal rows anyhow. A long text is one
document and is never cut; its segment is as long. Strings of special tokens are
encoded as the library does by default. An empty table gives an empty table. Only
the id and the text are read.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import dropped, on_workers, table, written
from .token_counts import byte_letters

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: Scale of the frequencies: shares of 2**BITS. States stay in 2**31 to 2**63.
BITS, LOW = 18, 2**31
LANES, STEPS, BLOCK, SEGMENT = 256, 256, 1 << 17, 1 << 22
CACHE_SIZE = 1 << 19
#: Texts are encoded together up to this many characters.
TOGETHER = 1 << 24
_HEAD = struct.Struct("<4s5I")
FILES = "shard int, segment int, start long, n long, bytes binary"


class _Known(dict):
    """What has been made before, in two generations: when one is full, it takes the place of the older one."""

    def __init__(self, make, size: int, longest: int):
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key) or self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def _ranges(pattern: str) -> str:
    """The characters below U+0250 that fit, as part of a character class."""
    return "".join(rf"\u{k:04x}" for k in range(0x250) if regex.fullmatch(pattern, chr(k)))


def _latin_pattern() -> re.Pattern:
    """The pattern of pre-tokens for characters below U+0250, spelled out: libraries differ on the separators 1C to 1F."""
    inside = {r"\s": r"\t-\r \x85\xa0", r"\p{L}": _ranges(r"\p{L}"), r"\p{N}": _ranges(r"\p{N}")}
    spelled = public_tokenizers.PATTERN.replace(r"\S", r"[^\s]")
    # Within a class as it is, elsewhere in brackets.
    return re.compile(re.sub(r"\[\^[^]]*\]|\\s|\\p\{.\}", lambda m: re.sub(r"\\s|\\p\{.\}", lambda c: inside[c[0]], m[0] if m[0][0] == "[" else f"[{m[0]}]"), spelled))


class Coder:
    """Ids of texts by the tokenizers library's model, remembered by chunks of text.

    Between a character that isn't a space and a space before one that is no
    white space, byte-level tokens always part, so a text is cut there. Chunks of
    Latin letters, in which there is no doubt what letters and white space are, are
    cut into pre-tokens whose merges the model makes; all others, and what may hold a
    special token, go through the library whole. Many texts are cut in Arrow, and
    each different chunk of theirs is put together once.
    """

    #: A space before white space or the end: there a text isn't cut.
    _ODD = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.tokenize = self.model.tokenize
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.pattern = _latin_pattern()
        self.known = _Known(self._chunk, CACHE_SIZE, 32)
        #: Ids take two bytes where the vocabulary allows it.
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = f"<u{array(self.code).itemsize}"

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _token(self, token: str) -> bytes:
        plain = token.isascii() and token.isprintable()
        piece = token.replace(" ", self.space) if plain else "".join(map(self.letters.__getitem__, token.encode("utf-8", "surrogatepass")))
        return self._packed([t.id for t in self.tokenize(piece)])

    def _chunk(self, chunk: str) -> bytes:
        # Most of what is new are plain words: as few calls as can be.
        if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            ids = [t.id for t in self.tokenize(self.space + chunk[1:] if chunk[0] == " " else chunk)]
            return array(self.code, ids).tobytes() if sys.byteorder == "little" else self._packed(ids)
        if "<|" in chunk or not (chunk.isascii() or max(chunk) < "\u0250"):
            return self._packed(self.library.encode(chunk, add_special_tokens=False).ids)
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return self._token(chunk)
        if word[:-1].isalpha() and word[-1] in ".,;:!?)":
            return self.known[chunk[:-1]] + self.known[chunk[-1]]
        found = self.pattern.findall(chunk)
        # A pre-token by itself is cut no further.
        return self._token(chunk) if len(found) == 1 else b"".join(map(self.known.__getitem__, found))

    def chunks(self, text: str) -> list[str]:
        """The text, cut before spaces that something other than white space follows."""
        first, *rest = text.split(" ")
        if not self._ODD.search(text):
            return [first, *[" " + p for p in rest]]
        out = [first]
        for p in rest:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def ids(self, text: str, end: int | None = END) -> bytes:
        """A text's ids and the end id, little-endian, of dtype."""
        found = b"".join(map(self.known.__getitem__, self.chunks(text)))
        return found if end is None else found + self._packed([end])

    def many(self, texts: Iterable[str], end: int | None = END) -> list[bytes]:
        """The ids of each text, as ids() gives them."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self._together(held, end)
                held, size = [], 0
        return out + self._together(held, end)

    def _parts(self, parts: Iterable[str]) -> list[bytes]:
        """The ids of different parts that a space precedes; of what is cut further only the pre-tokens are remembered."""
        known, find, out = self.known, self.pattern.findall, []
        for part in parts:
            if part.isalpha():
                out.append(known[" " + part])
            elif part.isascii() and "<" not in part or max(part) < "\u0250" and "<|" not in part:
                # Most often a word with a sign.
                if part[:-1].isalpha() and part[-1] in ".,;:!?)":
                    out.append(known[" " + part[:-1]] + known[part[-1]])
                else:
                    out.append(b"".join([known[p] for p in find(" " + part)]))
            else:
                out.append(known[" " + part])
        return out

    def _together(self, texts: list[str], end: int | None) -> list[bytes]:
        last = b"" if end is None else self._packed([end])
        out, places, rests = [], [], []
        for k, text in enumerate(texts):
            first, space, rest = text.partition(" ")
            if not space or self._ODD.search(text):
                out.append(self.ids(text, end))
            else:
                out.append(self.known[first])
                places.append(k)
                rests.append(rest)
        if rests:
            parts = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
            coded = parts.flatten().dictionary_encode()
            taken = pa.array(self._parts(coded.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary()).take(coded.indices)
            at = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][parts.offsets.to_numpy()].tolist()
            ids = memoryview(taken.buffers()[2])
            for k, low, high in zip(places, at, at[1:], strict=False):
                out[k] = b"".join((out[k], ids[low:high], last))
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The coder of a file, built once in each worker."""
    return Coder(path)


def encoded(df: DataFrame, id: str = "doc_id", text: str = "text", path: str = VOCABULARY, end: int | None = END) -> DataFrame:
    """(doc_id, n, ids) of every text; ids as binary, little-endian, of 16 bits where the vocabulary allows it, else of 32."""
    on_workers(df.sparkSession)
    width = int(coder(path).dtype[-1])

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path)
        for texts in batches:
            yield pd.Series(own.many(texts, end), dtype=object)

    ids = df.select(F.col(id).cast("long").alias("doc_id"), of(F.coalesce(F.col(text), F.lit(""))).alias("ids"))
    return ids.select("doc_id", F.expr(f"octet_length(ids) div {width}").alias("n"), "ids")


def unpacked(ids: bytes, n: int) -> np.ndarray:
    """n ids of a column `ids`."""
    return np.frombuffer(ids, f"<u{len(ids) // n if n else 4}").astype(np.uint32)


def frequencies(ids: DataFrame) -> np.ndarray:
    """How often each id occurs, scaled to 2**BITS, no id that occurs below 1; only a row an id comes to the driver."""
    on_workers(ids.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for blob, n in zip(batch["ids"], batch["n"], strict=True):
                more = np.bincount(unpacked(blob, n), minlength=len(counts))
                more[: len(counts)] += counts
                counts = more
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"id": seen, "n": counts[seen]})

    rows = ids.select("ids", "n").mapInPandas(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, object)
    counts[rows["id"].to_numpy()] = [int(n) for n in rows["n"]]
    return scaled(counts)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as shares of 2**BITS: at least 1 where there is any, the sum exact."""
    if (seen := int((counts > 0).sum())) > 1 << BITS:
        raise ValueError(f"more than {1 << BITS} different ids")
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    spare = (1 << BITS) - seen
    shares = np.array([int(c > 0) + spare * int(c) // total for c in counts], np.int64)
    shares[int(np.argmax(counts))] += (1 << BITS) - int(shares.sum())
    return shares.astype(np.uint32)


class Table:
    """The shared table: frequencies, where each id's share starts, and the id of every place."""

    def __init__(self, shares: np.ndarray):
        self.freq = shares.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.digest = zlib.crc32(shares.astype("<u4").tobytes())
        self.shares = shares

    @property
    def places(self) -> np.ndarray:
        """The id of each of the 2**BITS places; made when first asked for."""
        if "_places" not in self.__dict__:
            self._places = np.repeat(np.arange(len(self.shares), dtype=np.uint32), self.shares)
        return self._places


def _pushed(ids: np.ndarray, shared: Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Blocks of equal length (rows of ids) to the words of each, checkpoint states and word places.

    ids: (blocks, steps, lanes).
    """
    blocks, steps, lanes = ids.shape
    freq, start = shared.freq, shared.start
    state = np.full((blocks, lanes), LOW, np.uint64)
    shift, bits, low32 = np.uint64(32), np.uint64(BITS), np.uint64(0xFFFFFFFF)
    marks = range(0, steps, STEPS)
    states, kept = np.zeros((blocks, len(marks), lanes), np.uint64), np.zeros((blocks, len(marks)), np.int64)
    words: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for step in range(steps - 1, -1, -1):
        f, c = freq[ids[:, step]], start[ids[:, step]]
        full = state >= f << np.uint64(63 - BITS)
        words.append((state[full] & low32).astype(np.uint32))
        counts.append(full.sum(axis=1))
        state = np.where(full, state >> shift, state)
        whole = state // f
        state = (whole << bits) + (state - whole * f) + c
        if step % STEPS == 0:
            states[:, step // STEPS] = state
    counts_ = np.array(counts[::-1], np.int64).reshape(steps, blocks)
    before = np.cumsum(counts_, axis=0) - counts_
    for m, step in enumerate(marks):
        kept[:, m] = before[step]
    by_block: list[list[np.ndarray]] = [[] for _ in range(blocks)]
    for some, n in zip(words[::-1], counts_, strict=True):
        at = 0
        for b, k in enumerate(n.tolist()):
            by_block[b].append(some[at : at + k])
            at += k
    return [np.concatenate(w) if w else np.zeros(0, np.uint32) for w in by_block], states, kept


def packed(docs: list[int | None], lengths: list[int], ids: np.ndarray, shared: Table, lanes: int = LANES, block: int = BLOCK) -> bytes:
    """One segment's file."""
    n = len(ids)
    # What fills up the last step is the most frequent id, which costs least.
    fill = int(np.argmax(shared.shares))
    full = n // block
    parts = [ids[: full * block].reshape(full, -1, lanes)] if full else []
    if n % block:
        rest = ids[full * block :]
        parts.append(np.concatenate([rest, np.full(-len(rest) % lanes, fill, rest.dtype)]).reshape(1, -1, lanes))
    words, marks = [], []
    for part in parts:
        own, states, at = _pushed(part, shared)
        words += own
        marks += [s.astype("<u8").tobytes() + a.astype("<u4").tobytes() for s, a in zip(states, at, strict=True)]
    sizes = [min(block, n - k) for k in range(0, n, block)]
    sums = [zlib.crc32(ids[k : k + block].astype("<u4").tobytes()) for k in range(0, n, block)]
    null = np.packbits([d is None for d in docs]).tobytes()
    head = _HEAD.pack(b"RNS1", len(docs), len(sizes), lanes, STEPS, shared.digest)
    facts = np.array([[s, len(w), c] for s, w, c in zip(sizes, words, sums, strict=True)], "<u4").tobytes()
    return b"".join([head, np.array([d or 0 for d in docs], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), null, facts, *marks, *[w.astype("<u4").tobytes() for w in words]])


class Segment:
    """A file, read: its documents and, on demand, any of its ids."""

    def __init__(self, blob: bytes, shared: Table):
        magic, docs, blocks, self.lanes, self.steps, digest = _HEAD.unpack_from(blob)
        if magic != b"RNS1" or digest != shared.digest:
            raise ValueError("not a file of ids, or not one of this frequency table")
        at = _HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, dtype, n, at)
            at += found.nbytes
            return found

        ids, self.lengths = take("<i8", docs), take("<u8", docs).astype(np.int64)
        null = np.unpackbits(take("u1", -(-docs // 8)), count=docs)
        self.docs = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        facts = take("<u4", 3 * blocks).reshape(blocks, 3).astype(np.int64)
        self.sizes, self.sums, self.shared = facts[:, 0], facts[:, 2], shared
        self.marks = []
        for size in self.sizes.tolist():
            n = -(-size // (self.lanes * self.steps))
            self.marks.append((take("<u8", n * self.lanes).reshape(n, self.lanes), take("<u4", n).astype(np.int64)))
        self.words = np.concatenate([take("<u4", n) for n in facts[:, 1].tolist()]) if blocks else np.zeros(0, np.uint32)
        self.at = np.cumsum(facts[:, 1]) - facts[:, 1]

    def spans(self, marks: list[tuple[int, int]]) -> list[np.ndarray]:
        """The ids from each checkpoint (block, number) to the next, all side by side."""
        if not marks:
            return []
        shared, lanes = self.shared, self.lanes
        span = lanes * self.steps
        sizes = np.array([min(span, int(self.sizes[b]) - m * span) for b, m in marks])
        # The longest first, so that those still going are the first ones.
        order = np.argsort(-sizes, kind="stable")
        state = np.stack([self.marks[b][0][m] for b, m in (marks[k] for k in order)])
        place = np.array([self.at[b] + self.marks[b][1][m] for b, m in (marks[k] for k in order)])
        steps = -(-sizes[order] // lanes)
        out = np.zeros((len(marks), int(steps[0]), lanes), np.uint32)
        words = np.append(self.words, 0).astype(np.uint64)
        mask, bits, shift, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(LOW)
        going = np.searchsorted(-steps, -np.arange(int(steps[0])), side="left")
        for step, g in enumerate(going.tolist()):
            x = state[:g]
            slot = x & mask
            ids = shared.places[slot]
            out[:g, step] = ids
            x = shared.freq[ids] * (x >> bits) + slot - shared.start[ids]
            need = x < low
            n = need.sum(axis=1)
            first = np.cumsum(n) - n
            rank = np.minimum(np.arange(int(n.sum())) + np.repeat(place[:g] - first, n), len(words) - 1)  # beyond only if damaged
            x[need] = x[need] << shift | words[rank]
            state[:g] = x
            place[:g] += n
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(marks)
        for row, k in enumerate(order.tolist()):
            found[k] = out[row].ravel()[: sizes[k]]
        return found

    def ids(self) -> np.ndarray:
        """All ids, each block's checksum compared."""
        marks = [(b, m) for b in range(len(self.sizes)) for m in range(len(self.marks[b][1]))]
        found = np.concatenate([np.zeros(0, np.uint32), *self.spans(marks)])
        at = 0
        for b, (size, sum_) in enumerate(zip(self.sizes.tolist(), self.sums.tolist(), strict=True)):
            if zlib.crc32(found[at : at + size].astype("<u4").tobytes()) != sum_:
                raise ValueError(f"block {b} does not have its checksum")
            at += size
        return found

    def range(self, start: int, n: int) -> np.ndarray:
        """n ids from a place of the segment on, decoded from the checkpoint before it; checksums of whole blocks aren't compared."""
        span, ends = self.lanes * self.steps, np.cumsum(self.sizes)
        marks, first = [], None
        for b, end in enumerate(ends.tolist()):
            begin = end - int(self.sizes[b])
            for m in range(len(self.marks[b][1])):
                at = begin + m * span
                if at < start + n and min(at + span, end) > start:
                    marks.append((b, m))
                    first = at if first is None else first
        return np.concatenate([np.zeros(0, np.uint32), *self.spans(marks)])[start - (first or 0) :][:n]


def files(ids: DataFrame, shares: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n, ids), stored, to files: (shard, segment, start in the shard, n, bytes), documents in ascending order."""
    spark = ids.sparkSession
    on_workers(spark)
    sent = spark.sparkContext.broadcast(shares)  # a number an id of the vocabulary

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared, shard = Table(sent.value), TaskContext.get().partitionId()
        docs, held, size, number, start = [], [], 0, 0, 0

        def file() -> pd.DataFrame:
            blob = packed(docs, [len(x) for x in held], np.concatenate(held), shared)
            return pd.DataFrame({"shard": [shard], "segment": [number], "start": [start], "n": [size], "bytes": [blob]})

        for batch in batches:
            for doc, null, blob, n in zip(batch["doc_id"], batch["_null"], batch["ids"], batch["n"], strict=True):
                docs.append(None if null else int(doc))
                held.append(unpacked(blob, n))
                size += len(held[-1])
                if size >= segment:
                    yield file()
                    number, start = number + 1, start + size
                    docs, held, size = [], [], 0
        if docs:
            yield file()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that are equal in all but their place still part, so that no shard gets all copies.
    rows = ids.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("_null"), "ids", "n", F.xxhash64("ids").alias("_h"), F.monotonically_increasing_id().alias("_nth"))
    by = [F.desc("_null"), F.asc("doc_id"), F.asc("_h"), F.asc("_nth")]
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return ordered.select("doc_id", "_null", "ids", "n").mapInPandas(of, FILES)


def written_files(df: DataFrame, id: str = "doc_id", text: str = "text", path: str = VOCABULARY, end: int | None = END, segment: int = SEGMENT) -> tuple[DataFrame, np.ndarray]:
    """The files of a table's texts, stored in the shared folder, and their frequency table."""
    ids = written(encoded(df, id, text, path, end))
    shares = frequencies(ids)
    stored = written(files(ids, shares, segment))
    dropped(ids)
    return stored, shares


def read(stored: DataFrame, shares: np.ndarray) -> DataFrame:
    """Files to (doc_id, start, n_tokens, ids): every document with the number of ids before it, and its ids as binary."""
    return _decoded(stored, shares, "ids binary", lambda blob: blob)


def read_digests(stored: DataFrame, shares: np.ndarray) -> DataFrame:
    """Files to (doc_id, start, n_tokens, ids_crc32); ids don't leave the workers."""
    return _decoded(stored, shares, "ids_crc32 long", zlib.crc32)


def _decoded(stored: DataFrame, shares: np.ndarray, column: str, of_blob) -> DataFrame:
    spark = stored.sparkSession
    on_workers(spark)
    sent = spark.sparkContext.broadcast(shares)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = Table(sent.value)
        for batch in batches:
            for start, blob in zip(batch["start"], batch["bytes"], strict=True):
                own = Segment(blob, shared)
                ids, ends = own.ids().astype("<u4").tobytes(), np.cumsum(own.lengths)
                starts = ends - own.lengths
                found = [of_blob(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(own.docs, "Int64"), "start": int(start) + starts, "n_tokens": own.lengths, column.split()[0]: found})

    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A row a shard, of which there are as many as the shuffle has partitions.
    shards = stored.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", before.alias("before"))
    rows = stored.join(F.broadcast(shards), "shard").select((F.col("start") + F.col("before")).alias("start"), "bytes")
    return rows.mapInPandas(of, f"doc_id long, start long, n_tokens long, {column}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: place, number and checksum of every document's ids, as read back from the files."""
    return read_digests(*written_files(table(spark, sf_dir, "documents")))
