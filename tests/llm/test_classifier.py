"""The classifier's votes against a plain version, and their independence of blocks."""

import importlib
import math

import numpy as np
import pytest

qc = importlib.import_module("samplewright.llm.quality_classifier")

WORDS = ["river", "calm", "old", "bank", "BUY", "777", "$$$", "green", "hill", "stone", "bridge", "x" * 300, "ab" * 90 + "1"]


@pytest.fixture(scope="module")
def voters():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 40))) for _ in range(300)] * 2  # every text twice: ties
    return qc.Voters([qc.counts(t) for t in texts], [int("BUY" not in t) for t in texts])


def plain_score(voters, text):
    """Votes of one text, neighbour by neighbour."""
    row = qc.counts(text)
    if not row:
        return voters.mean
    x = np.zeros((1, qc.WIDTH))
    for column, n in row.items():
        x[0, column] = math.log1p(n)
    z = voters.latent(qc._blocks(x, voters.idf))[0]
    cosines = [sum(a * b for a, b in zip(z.tolist(), v.tolist(), strict=True)) / 4**qc.COSINE_BITS for v in voters.vectors]
    near = sorted(range(len(cosines)), key=lambda k: (-cosines[k], k))[: qc.NEIGHBOURS]
    weights = [max(cosines[k], 0.0) ** qc.POWER for k in near]
    total = sum(weights)
    return voters.mean if total <= 1e-12 else sum(w * voters.labels[k] for w, k in zip(weights, near, strict=True)) / total


def test_votes_by_brute_force(voters):
    rng = np.random.default_rng(5)
    texts = ["", " \n", "unseen", "x" * 300, "x" * 5000] + [" ".join(rng.choice(WORDS, rng.integers(1, 30))) for _ in range(40)]
    for text, score in zip(texts, voters.scores(texts), strict=True):
        assert score == pytest.approx(plain_score(voters, text), abs=1e-12), text


def test_scores_do_not_depend_on_the_block(voters):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 60))) for _ in range(700)]
    whole = voters.scores(texts)
    for n in (1, 7, 255, 300):
        assert np.array_equal(np.concatenate([voters.scores(texts[k : k + n]) for k in range(0, len(texts), n)]), whole)
    order = rng.permutation(len(texts))
    assert np.array_equal(voters.scores([texts[k] for k in order]), whole[order])


def test_long_words_count_whole():
    a, b = qc.counts("A" * 70 + "$" * 9 + "1"), qc.counts("A" * 70 + "b" * 9 + "1")
    assert {k for k in a if qc.WORDS <= k} != {k for k in b if qc.WORDS <= k}


def test_scores_through_spark_with_odd_rows(spark):
    good, bad = "the calm old bank by the green river ", "BUY 777 $$$ "
    rows = [(k, (good if k % 2 else bad) * (1 + k % 4), "x") for k in range(40)] + [(None, None, "x"), (41, "", "y"), (42, "x" * 200_000, None), (43, good * 3, "z"), (43, good * 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")  # a clashing name
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = qc.scored(docs, labels).collect()
    assert len(got) == len(rows) and docs.columns + ["score"] == qc.scored(docs, labels).columns
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    mean = qc.fitted(docs, labels).mean
    assert by_id[None] == by_id[41] == {mean} and len(by_id[43]) == 1 and by_id[43].pop() > 0.5
    assert {r["doc_id"] for r in qc.accepted(docs, labels).where("doc_id < 40").collect()} == set(range(1, 40, 2))
