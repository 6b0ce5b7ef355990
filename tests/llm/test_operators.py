"""Operators on small fixtures: against libraries, brute force and held-out labels."""

import importlib
import os
import re

import duckdb
import numpy as np
import pytest

byte_bpe, edit_fingerprint, html_extract, mixing, pii, quality_classifier, quality_rules, simhash, token_counts, url_filter = (
    importlib.import_module(f"samplewright.llm.{n}")
    for n in ("byte_bpe", "edit_fingerprint", "html_extract", "mixing", "pii", "quality_classifier", "quality_rules", "simhash", "token_counts", "url_filter")
)

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int, point string, size string, host string"
LINE = "The quick brown fox jumps over a lazy dog near the old river bank while seven calm birds watch it go. "
TEXTS = [
    None, "", " \n\t", "one", LINE * 3, LINE * 3, (LINE * 3).upper(), "Mail bob (at) site dot org or ann@site.com, 10.0.0.1.",
    "word " * 30000, "x" * 20000, "#### $$$$ %%%% " * 40, "naïve café Ünïcode 你好 \U0001f600 <|endoftext|>", LINE * 40 + "tail",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 5 == 4 else f"s{k % 3}", len(t or ""), "p", "s", "h") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", None, None, None, None, None, None)], DOCUMENTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def sql(text, **tables):
    with duckdb.connect() as c:
        for name, frame in tables.items():
            c.register(name, frame)
        found = c.sql(text)
        return found.columns, found.fetchall()


def same(df, text, source):
    columns, want = sql(text, **source)
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b, nan_ok=True)


def test_rules_and_mix_agree_with_sql(docs):
    source = {"documents": docs.toPandas()}
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    same(quality_rules.quality_votes(docs).select(*columns), quality_rules.oracle(), source)
    same(mixing.mixed(docs), mixing.oracle(), source)


def test_mix_texts_have_the_words_taken(docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(words(r["text"]) for r in mixing.mixed_texts(docs).collect()) == sum(r["taken"] for r in mixing.mixed(docs).collect())


def test_bpe_is_the_library_and_round_trips():
    import base64

    import public_tokenizers
    import tiktoken

    with open(byte_bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.coder(byte_bpe.VOCABULARY)
    for t in TEXTS:
        ids = own.encode(t or "")
        assert ids.tolist() == library.encode_ordinary(t or "")
        assert own.decode(ids) == (t or "").encode()


def test_token_counts_are_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.VOCABULARY)
    library.no_truncation()
    library.no_padding()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(docs).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k] == len(library.encode(t or "", add_special_tokens=False).ids)


def test_pii_spans_map_back():
    text = TEXTS[7]
    found = {(kind, text[a:b]) for kind, a, b, _ in pii.spans(text)}
    assert {("email", "ann@site.com"), ("email", "bob (at) site dot org"), ("ip", "10.0.0.1")} <= found
    assert pii.redacted(text) == "Mail [EMAIL] or [EMAIL], [IP]."
    assert pii.spans("") == []


def test_simhash_classes_by_brute_force(spark):
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    points = [int(p) ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 3), replace=False))) for p in seeds for _ in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(points)), "doc_id long, point long")).collect()}
    label = list(range(len(points)))
    for _ in label:
        new = [min(label[j] for j in range(len(points)) if (points[i] ^ points[j]).bit_count() <= 2) for i in range(len(points))]
        if new == label:
            break
        label = new
    assert [got[k] for k in range(len(points))] == label


def test_simhash_keeps_one_of_each(docs):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    ids = sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None)
    assert 0 in ids and not {1, 2, 5, 6} & set(ids)


PAGE = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><div class="top">Site of {host}</div>{body}<footer>&copy; x</footer></body></html>'


def test_html_wrappers(spark):
    divs = [PAGE.format(host="a", body=f"<div class=c><h1>Title {k}</h1><p>Text &amp; more\n {k}.<p>End {k}<br></div><div class='comments'>No {k}</div>") for k in range(5)]
    article = PAGE.format(host="b", body="<article><h1>T</h1><p>Same<script>if (a<b) '</p>'</script></p></article>")
    rows = [(k, f"http://a.example/{k}", h) for k, h in enumerate(divs)] + [(10 + k, "http://b.example/", article) for k in range(3)] + [(20, None, None), (21, "x", ""), (22, "http://c/", "plain < text")]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(5)] == [f"Title {k}\n\nText & more {k}.\n\nEnd {k}" for k in range(5)]
    assert [got[10 + k] for k in range(3)] == ["T\n\nSame"] * 3
    assert (got[20], got[21], got[22]) == ("", "", "plain < text")


def test_deep_html_loses_nothing():
    _, blocks = html_extract.parse("<div><section>" * 5000 + "deep" + "</section></div>" * 5000)
    assert [b[0] for b in blocks] == ["deep"]


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/7x", "https://a.com/en/1", "http://b.example.net/de/8", "http://net/de/9", "http://x/casino/", None, "no scheme", "http://xcom/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["name"], r["action"]) for r in url_filter.judged(df, url_filter.FIXED + url_filter.PATTERNS).collect()}
    want = [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("casino", "block"), (None, None), (None, None), (None, None)]
    assert [got[k] for k in range(8)] == want


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality_classifier.query(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) >= 0.95


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_classifier.scored(docs, labels).collect()} == {0.5}


def test_edit_fingerprints(docs):
    rows = {r["doc_id"]: r for r in edit_fingerprint.edited_likeness(docs).collect()}
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"]
    assert rows[5]["near_next"] == 1 and rows[12]["near_edited"] > rows[12]["near_next"]


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (quality_rules.quality_votes(none), pii.with_spans(none), mixing.mixed(none), mixing.mixed_texts(none), simhash.one_of_each(none), byte_bpe.digests(none),
               token_counts.counted(none), quality_classifier.scored(none, labels), edit_fingerprint.edited_likeness(none)):
        assert df.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extracted(pages).count() == 0
