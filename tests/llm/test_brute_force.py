"""Operators SQL can't express, against plain versions of themselves."""

import hashlib
import importlib
import itertools
import re

import duckdb
import numpy as np
import pytest

byte_bpe, edit_fingerprint, mixing, pii, quality_classifier, simhash, url_filter = (
    importlib.import_module(f"samplewright.llm.{n}") for n in ("byte_bpe", "edit_fingerprint", "mixing", "pii", "quality_classifier", "simhash", "url_filter")
)


def base_spans(text):
    """Base personal data by its defining patterns alone."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(kind, *m.span()) for kind, pattern, fits in rules for m in re.finditer(pattern, text) if fits(m.group())]


def test_base_personal_data_by_pattern():
    rng = np.random.default_rng(3)
    parts = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", " ", "-", "7", "é", "٣", "a@b.c@d.e", "00012.3.4.5", "(at)", " dot "]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert [(k, a, b) for k, a, b, base in pii.spans(text) if base] == base_spans(text), text


def test_walk_step_by_step():
    coins = np.random.default_rng(edit_fingerprint.SEED).integers(0, 2, (256, edit_fingerprint.PERIOD), dtype=np.uint8)
    coins[:, -1] = 1
    for text in ("", "a", "hello there " * 50, "naïve 你好 \U0001f600" * 9, "x" * 3000):
        put, step = [], 0
        for c in map(ord, text):
            kind = (c + 37 * (c >> 8)) & 255
            while True:
                put.append(kind)
                step += 1
                if coins[kind, (step - 1) % edit_fingerprint.PERIOD]:
                    break
        at = [p for p in edit_fingerprint._walk()[1] if p < len(put)]
        assert list(edit_fingerprint.Walk().read(text).seen) == [put[p] for p in at]
        assert len(edit_fingerprint.fingerprint(text)) == len(at)


def test_edited_texts_by_sorting(spark):
    texts = [None, "", "abc", "abcd" * 50, "z" * 999, "naïve 你好"] * 3
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in edit_fingerprint.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        t, after = text or "", texts[k - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        mine, other, changed = map(edit_fingerprint.fingerprint, (t, after, edited))
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (mine, changed)
        assert got[k]["near_edited"] == pytest.approx(edit_fingerprint.likeness(mine, changed))
        assert got[k]["near_next"] == pytest.approx(edit_fingerprint.likeness(mine, other))


def test_edits_cost_likeness_in_proportion():
    rng = np.random.default_rng(5)
    text = "".join(chr(97 + k) for k in rng.integers(0, 26, 4000))
    few = text[:1000] + "Q" + text[1001:2000] + text[2003:]
    found = [edit_fingerprint.likeness(edit_fingerprint.fingerprint(text), edit_fingerprint.fingerprint(t)) for t in (text, few, text[:2000] + text[::-1][:2000], text[::-1])]
    assert found == sorted(found, reverse=True) and found[0] == 1 and found[1] > 0.8 > 0.3 > found[3]


def test_equal_fingerprints_are_one_class(spark):
    text = "the calm birds watch the river bank go by " * 20
    rows = [(k, edit_fingerprint.fingerprint(text)) for k in range(200)] + [(900, edit_fingerprint.fingerprint("0123456789" * 90)), (None, ""), (901, "")]
    found = edit_fingerprint.written(spark.createDataFrame(rows, "doc_id long, fingerprint string"))
    got = {r["doc_id"]: r["near_class"] for r in edit_fingerprint.near_classes(found).collect()}
    assert got == {**{k: 0 for k in range(200)}, 900: 900, 901: 901, None: 901}


def test_both_ways_to_find_url_rules(spark, monkeypatch):
    urls = ["https://a.com/en/1", "http://x/casino/", "http://my.poker.net/spam/", None, "none", "http://net/de/9"] * 4 + ["http://hot.com/en/"] * 50
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.FIXED + url_filter.PATTERNS
    sent = sorted(map(tuple, url_filter.judged(df, rules).collect()), key=str)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, url_filter.judged(df, rules).collect()), key=str) == sent


def test_pipeline_stage_by_stage(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(11)
    vocabulary = ["river", "calm", "old", "bank", "birds", "watch", "green", "hill", "stone", "bridge", "seven", "lamp"]
    good = [" ".join(rng.choice(vocabulary, 80)) + ". Write to ann@site.com." for _ in range(30)]
    junk = ["$$$ ### " * int(rng.integers(20, 60)) + "BUY 777" for _ in range(15)]
    texts = [*good, *junk, *good[:8], None, "", good[0]]
    rows = [(k, t, "en", f"s{k % 2}" if k % 7 else None, len(t or ""), "extra") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, taken string").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(k, int(k < 30 or k >= 45), 0) for k in range(len(texts) - 3)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.scored(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    left = [r for r in rows if scores[r[0]] >= quality_classifier.THRESHOLD]
    assert {r[0] for r in left} >= set(range(30)) and not {r[0] for r in left} & set(range(30, 45))
    # One of each class of linked fingerprints, the smallest id.
    points = {r[0]: simhash.fingerprint(r[1] or "") for r in left}
    label = {k: k for k in points}
    for a, b in itertools.product(points, repeat=2):
        if (points[a] ^ points[b]).bit_count() <= 2:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    kept = [(r[0], r[1] and pii.redacted(r[1]), *r[2:]) for r in left if label[r[0]] == r[0]]
    assert all("@" not in (r[1] or "") for r in kept)
    with duckdb.connect() as c:
        c.register("documents", spark.createDataFrame(kept, docs.schema).toPandas())
        taken = {r[0]: r[4] for r in c.sql(mixing.oracle()).fetchall()}
    mixed = pipeline.mixed(spark, spark.createDataFrame(kept, docs.schema), str(tmp_path)).collect()
    words = {}
    for r in mixed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == {k: n for k, n in taken.items() if n}
    want = []
    for r in mixed:
        ids = byte_bpe.coder(byte_bpe.VOCABULARY).encode(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)
