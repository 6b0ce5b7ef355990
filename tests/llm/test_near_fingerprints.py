"""Classes of like fingerprints: under keys whose smallest node is not alike, and their recall on random edits."""

import importlib
import itertools

import numpy as np

edit_fingerprint = importlib.import_module("samplewright.llm.edit_fingerprint")


def classes_by_brute_force(prints):
    label = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if edit_fingerprint.likeness(prints[a], prints[b]) >= 0.8 and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if v == high else v for v in label]
    return label


def classes(spark, prints):
    found = edit_fingerprint.written(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string"))
    got = {r["doc_id"]: r["near_class"] for r in edit_fingerprint.near_classes(found).collect()}
    return [got[k] for k in range(len(prints))]


def test_links_past_an_unlike_head(spark, monkeypatch):
    # One key for all, as a shared template gives.
    monkeypatch.setattr(edit_fingerprint, "band_keys", lambda found, level=0: [7])
    rng = np.random.default_rng(2)
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 26, 3000)) for _ in range(6)]
    for t in texts[1:5]:
        texts += [t[:2500] + "Q" + t[2501:], t, t[:2400] + "some other words" + t[2416:]]
    prints = [edit_fingerprint.fingerprint(t) for t in texts]
    want = classes_by_brute_force(prints)
    assert len(set(want)) == 6 and classes(spark, prints) == want


def edited(rng, text):
    """One to three random edits: characters put in, left out or replaced, somewhere."""
    for _ in range(int(rng.integers(1, 4))):
        at, n = int(rng.integers(0, len(text))), int(rng.integers(1, 30))
        text = text[:at] + "".join(chr(97 + k) for k in rng.integers(0, 26, int(rng.integers(0, 30)))) + text[at + n :]
    return text


def test_recall_on_random_edits(spark):
    rng = np.random.default_rng(4)
    texts = []
    for length in (60, 300, 800, 2500, 9000):
        for _ in range(4):
            text = "".join(chr(97 + k) for k in rng.integers(0, 26, length))
            texts += [text] + [edited(rng, text) for _ in range(9)]
    prints = [edit_fingerprint.fingerprint(t) for t in texts]
    want, got = classes_by_brute_force(prints), classes(spark, prints)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if want[a] == want[b]]
    assert len(pairs) > 150
    assert all(want[a] == want[b] for a, b in itertools.combinations(range(len(texts)), 2) if got[a] == got[b])
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_rows_without_ids_are_ordered_by_hash(spark):
    rows = [(None, f"text {k} " * (k % 7 + 1)) for k in range(300)] + [(None, None)] * 5 + [(k, f"known {k}") for k in range(20)] * 2
    got = edit_fingerprint.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert sum(r["doc_id"] is None for r in got) == 305
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
