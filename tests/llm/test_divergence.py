"""Distances of sources and their terms, against counting by hand and SQL."""

import importlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tests.llm.test_operators import DOCUMENTS, TEXTS, same

audit = importlib.import_module("samplewright.llm.divergence_audit")
SCHEMA = "doc_id long, text string, lang string, source string, term string, i string, value string, document string"


def by_hand(rows, least, top):
    groups, seen, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, found = lang or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]
        groups[lang, source or ""].update(found)
        total[lang].update(found)
        seen[lang].update(set(found))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = share(own), share(total[lang])
        others = [(-sum(abs(p[t] - share(c)[t]) for t in kept), s) for (at, s), c in groups.items() if at == lang and s != source]
        out += [(lang, source, "pair", s, -f, k) for k, (f, s) in enumerate(sorted(others, key=lambda x: (x[0], x[1].encode())), 1)]
        above = sorted(((q[t] - p[t], t.encode()) for t in kept if own[t] and p[t] > q[t]))[:top]
        out += [(lang, source, "term", t.decode(), -f, k) for k, (f, t) in enumerate(above, 1)]
    return sorted(out)


def rows_of(seed=3, n=300):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "BETA", "gamma", "élan", "ÉLAN", "été", "x", "don", "t", "日本", "\U0001f600"]
    rows = []
    for k in range(n):
        text = "".join(w + sep for w, sep in zip(rng.choice(words, 8), rng.choice([" ", "'", "1", "\n", "_", "\x7f", "."], 8), strict=True))
        # One source has a third of all rows.
        rows.append((k % 250 if k % 7 else None, text if k % 11 else None, [None, "", "en", "de"][rng.integers(4)], None if k % 13 == 0 else f"s{rng.integers(7) if k % 3 else 0}", "c", "c", "c", "c"))
    return [*rows, (1000, "lonely words", "xx", "only"), (1001, None, "yy", "a"), (1001, "", "yy", "b")]


@pytest.mark.parametrize(("least", "top", "size"), [(1, 3, 128), (20, 50, 2), (10_000, 5, 3)])
def test_audit_is_counting_by_hand(spark, least, top, size):
    rows = [(*r, *["c"] * (8 - len(r))) for r in rows_of()]
    got = audit.audit(spark.createDataFrame(rows, SCHEMA), least, top, size=size)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, least, top)


def test_audit_agrees_with_sql(spark):
    rows = [(k, t, "en", None if k % 5 == 4 else f"s{k % 3}", len(t or ""), "p", "s", "h") for k, t in enumerate(TEXTS * 40)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    same(audit.audit(docs), audit.oracle(), {"documents": docs.toPandas()})


def test_runs_go_on_over_batches():
    rows = pd.DataFrame([("en", t, s, d, 1, 2) for t in "abc" for s in "xyz" for d in range(7)], columns=["lang", "term", "source", "document", "n_documents", "n"])
    whole = pd.concat(audit._runs(iter([rows]), 21)).reset_index(drop=True)
    assert whole["n"].tolist() == [14] * 9 and whole["total"].tolist() == [42] * 9 and whole["head"].sum() == 3
    for size in (1, 2, 5, 20, 21, 22):
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        pd.testing.assert_frame_equal(pd.concat(audit._runs(iter(parts), 21)).reset_index(drop=True), whole)


def test_runs_stay_in_arrow(spark):
    """What is scanned never becomes Python strings, and the sort's last key isn't sent to the workers."""
    docs = spark.createDataFrame([(k, "Ab ab c", "en", f"s{k % 3}") for k in range(40)], "doc_id long, text string, lang string, source string")
    kept = audit.kept_terms(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.splitlines()[0]
    assert " document#" not in plan.splitlines()[1]
    assert sorted(map(tuple, kept.drop("head").collect())) == [("en", t, f"s{k}", n * (14 - (k > 0)), n * 40) for t, n in (("ab", 2), ("c", 1)) for k in range(3)]


def test_shares_are_exact_beyond_longs(spark):
    F = importlib.import_module("pyspark.sql.functions")
    n, all_, v = 4 * 10**17 + 1, 9 * 10**17, 10**6
    got = spark.range(1).select(audit._share(F.lit(n), F.lit(all_), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (all_ + 5 * v)


def test_long_texts_split_at_blanks_only():
    audit.PIECE, before = 10, audit.PIECE
    try:
        text = "ab cd " * 30 + "é" * 50 + " z"
        assert [t for some in audit.terms(text) for t in some] == text.encode().split()
    finally:
        audit.PIECE = before


def test_empty_table(spark):
    assert audit.audit(spark.createDataFrame([], SCHEMA)).collect() == []
