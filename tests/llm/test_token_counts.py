"""The first tier of token counts: what it holds, how much it resolves, and that no count depends on it."""

import importlib
from collections import Counter

import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tests.llm.test_operators import DOCUMENTS, TEXTS

counts = importlib.import_module("samplewright.llm.token_counts")
TABLE = "/root/testdata/sf0.01"


def test_first_tier_resolves_most_of_a_corpus(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    own, first, found, all_ = counts.splitter(counts.VOCABULARY), counts.frequent(docs), 0, Counter()
    for text in pq.read_table(f"{TABLE}/documents.parquet").column("text").to_pylist():
        all_.update(own.split(text or "")[0])
    words = list(all_)
    lengths = first.find([w.encode("utf-8", "surrogatepass") for w in words])
    found = sum(all_[w] for w, n in zip(words, lengths.tolist(), strict=True) if n >= 0)
    assert found >= 0.8 * all_.total()
    # The most frequent ones are all there, with the library's lengths.
    library = Tokenizer.from_file(counts.VOCABULARY)
    top = [w for w, _ in all_.most_common(1000)]
    got = first.find([w.encode() for w in top]).tolist()
    assert (sum(n >= 0 for n in got) == 1000) and all(n == len(library.encode(w, add_special_tokens=False).ids) for w, n in zip(top, got, strict=True))


def test_tops_keep_what_is_frequent():
    tops = counts.Tops(held=64)
    for k in range(500):
        tops.add(["often", "often", "again", *(f"rare{k}-{j}" for j in range(10))])
    assert tops.counts["often"] == 1000 and tops.counts["again"] == 500 and len(tops.counts) <= 64 + 12


def test_no_count_depends_on_the_tier(spark, monkeypatch):
    rows = [(k, t, "en", "s", 1, "p", "s", "h") for k, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    want = sorted(map(tuple, counts.counted(docs).collect()), key=lambda r: r[0])
    for entries in (0, 3):
        monkeypatch.setattr(counts, "frequent", lambda df, text, path, n=entries: counts.FrequentLengths(dict.fromkeys([], 0)) if not n else counts.FrequentLengths({w: counts.splitter(path).length(w) for w in ("the", "fox", "naïve")}))
        assert sorted(map(tuple, counts.counted(docs).collect()), key=lambda r: r[0]) == want


def test_first_tier_of_no_texts(spark):
    assert counts.counted(spark.createDataFrame([], DOCUMENTS)).collect() == []
