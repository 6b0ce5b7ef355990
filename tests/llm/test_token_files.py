"""Files of token ids: the coder by round trips, the query against the tokenizers library."""

import importlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_operators import DOCUMENTS, TEXTS

files = importlib.import_module("samplewright.llm.token_files")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(files.VOCABULARY)


def test_ids_are_the_librarys(library):
    rng = np.random.default_rng(2)
    letters = ["a", "b", "don't", "The", "12", "é", "日本", "\U0001f600", ".", "!?", " ", " ", "  ", "\n", " \n", "\n ", "\t", "\x1c", "\x1f ", " ", "  ", "　", " ", "\x85", "<|endoftext|>", "<|endoftext|", "'s", " '"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(4000)]
    texts += [t for t in TEXTS if t] + ["", " ", "  ", " a", "a ", "a  b", "x" * 300_000, "word " * 50_000, "<|endoftext|> <|endoftext|>"]
    own = files.Coder(files.VOCABULARY)
    for text in [*texts, *texts[:200]]:
        assert "".join(own.chunks(text)) == text
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("together", [1, 300, files.TOGETHER])
def test_many_texts_together(library, monkeypatch, together):
    """The same ids however many texts go together; a word is merged once, whatever sign follows it, and only pre-tokens are remembered."""
    monkeypatch.setattr(files, "TOGETHER", together)
    rng = np.random.default_rng(5)
    letters = ["a", "Naïve", "don't", "x1", "12", "é²", "日本", "ж", "\U0001f600", ".", "!?", "\n", "\t", "\x1c", "\xa0", "\x85", "<", "<|", "<|endoftext|>", "'s"]
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 5))) for _ in range(rng.integers(1, 9))) for _ in range(1500)]
    texts += [t for t in TEXTS if t] + ["", " ", "a", "a ", " a", "  a", "a  b", "a b", "one two", "ж, ж."]
    own = files.Coder(files.VOCABULARY)
    for found, text in zip(own.many(texts), texts, strict=True):
        assert np.frombuffer(found, own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert own.many(texts, None) == [own.ids(t, None) for t in texts] and own.many([]) == []
    own = files.Coder(files.VOCABULARY)
    assert own.many(["so zweebly, zweebly. zweebly\nzweebly; zweebly"]) == [own.ids("so zweebly, zweebly. zweebly\nzweebly; zweebly")]
    own = files.Coder(files.VOCABULARY)
    own.many(["so zweebly, zweebly. zweebly\nzweebly; zweebly"])
    assert set(own.known) == {"so", " zweebly", "zweebly", ",", ".", "\n", ";"}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 65_535, 65_536, 65_537, 1 << 18, (1 << 18) + 1, 700_001])
def test_files_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    shared = files.Table(files.scaled(np.bincount(ids, minlength=50_257).astype(object) if n else np.ones(9, object)))
    blob = files.packed([3, None, 9], [n // 3, 0, n - n // 3], ids, shared)
    own = files.Segment(blob, shared)
    assert own.docs == [3, None, 9] and own.lengths.tolist() == [n // 3, 0, n - n // 3]
    assert (own.ids() == ids).all()
    for start, m in ((0, 1), (n // 2, 1000), (max(0, n - 5), 5), (n // 3, n // 2), (n, 4)):
        assert (own.range(start, m) == ids[start : start + m]).all()


def test_files_are_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.2, 1 << 20) % 50_000).astype(np.uint32)
    counts = np.bincount(ids).astype(object)
    p = counts[counts > 0].astype(float) / len(ids)
    blob = files.packed([1], [len(ids)], ids, files.Table(files.scaled(counts)))
    assert len(blob) < 1.05 * len(ids) * -(p * np.log2(p)).sum() / 8


def test_one_id_alone_and_all_ids():
    for ids in (np.full(1000, 7, np.uint32), np.arange(50_257, dtype=np.uint32)):
        shared = files.Table(files.scaled(np.bincount(ids).astype(object)))
        assert (files.Segment(files.packed([1], [len(ids)], ids, shared), shared).ids() == ids).all()


def test_shares_add_up():
    rng = np.random.default_rng(3)
    for counts in ([1], [0, 1], [10**15, 1, 0, 1], rng.integers(0, 3, 60_000).tolist(), [10**18] * 3):
        shares = files.scaled(np.array(counts, object))
        assert shares.sum() == 1 << files.BITS and ((shares > 0) == (np.array(counts, object) > 0)).all()


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint32) % 900
    shared = files.Table(files.scaled(np.bincount(ids).astype(object)))
    blob = bytearray(files.packed([1], [5000], ids, shared))
    blob[-3000] ^= 16
    with pytest.raises(ValueError, match="checksum"):
        files.Segment(bytes(blob), shared).ids()
    other = files.Table(files.scaled(np.arange(1, 901).astype(object)))
    with pytest.raises(ValueError, match="frequency table"):
        files.Segment(bytes(blob), other)
    with pytest.raises(ValueError, match="not a file"):
        files.Segment(b"RNS2" + bytes(blob[4:]), shared)


@pytest.mark.parametrize("segment", [1, 5000, files.SEGMENT])
def test_documents_come_back_in_order(spark, library, segment):
    """Null, repeated and negative ids, equal rows, columns of clashing names."""
    rows = [(k * 37 % 101 - 20, t, "en", "s", 1, "p", "s", "h") for k, t in enumerate(TEXTS * 3)]
    rows += [(5, "copies of one row " * 9, "en", "s", 1, "p", "s", "h")] * 60 + [(5, f"the same id {k}", "en", "s", 1, "p", "s", "h") for k in range(40)]
    rows += [(None, "no id", "en", "s", 1, "p", "s", "h")] * 2
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    stored, shares = files.written_files(docs, segment=segment)
    got = files.read(stored, shares).orderBy("start").collect()
    want = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted((d is not None, d or 0, i) for d, i in want)
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    starts = np.cumsum([0, *(r["n_tokens"] for r in got)])
    assert [r["start"] for r in got] == starts[:-1].tolist()
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    digests = files.read_digests(stored, shares).orderBy("start").collect()
    assert [(r["doc_id"], r["ids_crc32"]) for r in digests] == [(r["doc_id"], zlib.crc32(r["ids"])) for r in got]


def test_query_is_the_library_on_a_table(spark, library):
    """All rows of the smallest table; ids are distinct there, so the order is one."""
    got = [tuple(r) for r in files.query(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    start, want = 0, []
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got) == want


def test_empty_table(spark):
    stored, shares = files.written_files(spark.createDataFrame([], DOCUMENTS))
    assert files.read_digests(stored, shares).collect() == []
