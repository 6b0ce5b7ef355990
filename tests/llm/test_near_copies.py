"""The pipeline's near-duplicate stage against brute-force Jaccard on edited copies."""

import importlib
import itertools
import time

import numpy as np
import pytest

shingles = importlib.import_module("samplewright.llm.shingles")


def similarity(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def smallest_of_groups(texts, alike):
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if alike(texts[a], texts[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if v == high else v for v in label]
    return {k for k, v in enumerate(label) if k == v}


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_stage_removes_edited_copies(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(17)
    texts = []
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 500, 150)]
        # Up to 40 of 146 shingles change: on both sides of 0.8.
        texts += [" ".join(words)] + [edited(rng, words, n) for n in (1, 2, 3, 3, 4, 6, 8)]
    texts += ["", "  ", "one two", "One  TWO", "one three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in pipeline.distinct(spark, docs, str(tmp_path)).collect()}
    assert left == smallest_of_groups(texts, lambda a, b: a.lower().split() == b.lower().split() or bool(a.split() and b.split()) and similarity(a, b) >= 0.8)
    assert len(left) < 70


def passages(rng, groups, common=120, own=60):
    """Texts that all share a passage of more than half; only copies of the same tail are alike."""
    texts, head = [], [f"c{k}" for k in range(common)]
    for _ in range(groups):
        tail = [f"t{k}" for k in rng.integers(0, 50_000, own)]
        texts += [" ".join(head + tail), " ".join(head) + " " + edited(rng, tail, 2)]
    return texts


@pytest.mark.parametrize(("wide", "chunk"), [(4, 1 << 26), (1000, 4000)])
def test_wide_keys_lose_no_link(spark, monkeypatch, wide, chunk):
    monkeypatch.setattr(shingles, "WIDE", wide)
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    texts = passages(np.random.default_rng(23), 15)
    # Some are nearly all passage, on both sides of 0.8 to each other.
    texts += [" ".join([f"c{k}" for k in range(120)] + [f"u{k}x{j}" for j in range(n)]) for k, n in enumerate((4, 8, 12, 14, 16, 20, 30, 14, 12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in shingles.one_of_each(docs).collect()}
    assert left == smallest_of_groups(texts, lambda a, b: similarity(a, b) >= 0.8)


def test_alike_sets_share_a_prefix():
    rng = np.random.default_rng(5)
    common = rng.choice(np.arange(1, 60, dtype=np.uint64), 30, replace=False)
    met = 0
    for _ in range(20_000):
        a = np.unique(rng.integers(1, 60, rng.integers(0, 40)).astype(np.uint64))
        b = np.setdiff1d(np.union1d(a, rng.integers(1, 90, rng.integers(0, 4)).astype(np.uint64)), rng.integers(1, 60, rng.integers(0, 4)).astype(np.uint64))
        if len(a) and len(b) and shingles.jaccard(a, b) >= 0.8:
            met += 1
            assert set(shingles.prefix(a, common, 0.8)) & set(shingles.prefix(b, common, 0.8))
    assert met > 3000 and len(shingles.prefix(a[:0], common, 0.8)) == 0
    assert shingles.prefix(np.array([3, 5, 9], np.uint64), common[:0], 0.8).tolist() == [3]
    assert shingles.prefix(np.array([3, 5, 9, 11, 13], np.uint64), np.array([3, 9], np.uint64), 0.8).tolist() == [5, 11]


def test_many_texts_with_one_passage_take_bounded_work(spark):
    """Twenty thousand that share more than half: none of them meets all others."""
    texts = passages(np.random.default_rng(29), 10_000, 100, 50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    left = [r["doc_id"] for r in shingles.one_of_each(docs).collect()]
    assert time.perf_counter() - began < 300
    # Copies of a tail are alike to 0.8 or more unless both edits fall so that more than a fifth of the shingles differ.
    pair = lambda k: similarity(texts[2 * k], texts[2 * k + 1]) >= 0.8
    assert sorted(left) == sorted(d for k in range(10_000) for d in ([2 * k] if pair(k) else [2 * k, 2 * k + 1]))


def test_fingerprints_alone_find_the_closest_copies(spark, monkeypatch, tmp_path):
    """op5's fingerprints are a step of their own: without any min-hash the stage still links what lies within their radius and is alike."""
    pipeline = pytest.importorskip("corpus_pipeline")
    simhash = importlib.import_module("samplewright.llm.simhash")
    monkeypatch.setattr(shingles, "band_keys", lambda found: np.zeros(0, np.int64))
    rng = np.random.default_rng(31)
    texts = []
    for _ in range(10):
        words = [f"w{k}" for k in rng.integers(0, 5000, 1500)]
        texts += [" ".join(words), *(edited(rng, words, n) for n in (1, 2, 5))]
    texts += ["", " "]
    near = lambda a, b: similarity(a, b) >= 0.8 and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in pipeline.distinct(spark, docs, str(tmp_path)).collect()}
    assert left == smallest_of_groups(texts, near)
    assert len(left) < 25
