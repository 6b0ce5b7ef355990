"""URL rules: all rules on all addresses as brute force, both ways, odd addresses."""

import importlib
import re
import time

import duckdb
import pytest

uf = importlib.import_module("samplewright.llm.url_filter")

URLS = [
    "http://WWW.Example.com/en/7x", "https://a.com/en/1", "http://x/casino/", "http://my.poker.net/spam/", None, "none", "http://net/de/9", "http://h/po\u212aer/x", "http://h/ca\u017fino/",
    "http://h/POKER/", "http://ads.site.org/x", "http://x.ADS.site.org/", "http://badads.site.org/", "http://h/ad/click/", "http://h/ad-click", "http://h/adclick", "http://h/buy/now/cheap/",
    "http://h/casino/x/addiction/help", "http://h/report/spam", "http://h/wp-login.php", "http://h/wp-login.phpx", "http://h/a\nb/spam\n", "http://h/cgi-bin/x/y.cgi", "://", "a://b://casino",
    "http://h/free%20download", "http://h/free.download.", "http://h/" + "x/" * 50_000 + "casino", "http://" + "a" * 100_000, "http://h?casino", "http://h/\u0130nfo/win/a/prize",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r.tier, -len(r.pattern), r.name, r.action) for r in rules if host + path and re.search(uf.expression(r), host + path)]
    return host, path, *(min(fits)[2:] if fits else (None, None))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, u, "clash", 1) for k, u in enumerate(URLS * 2)], "page_id long, url string, token string, salt int")


@pytest.mark.parametrize("most", [10**5, 0])
def test_both_ways_by_brute_force(df, monkeypatch, most):
    monkeypatch.setattr(uf, "MAX_BROADCAST", most)
    rules = uf.FIXED + uf.PATTERNS
    got = {r["page_id"]: (r["host"], r["path"], r["name"], r["action"]) for r in uf.judged(df, rules).collect()}
    assert len(got) == 2 * len(URLS)
    for k, url in enumerate(URLS * 2):
        assert got[k] == brute(url, rules), url[:60] if url else url


def test_rarest_token_is_chosen(spark):
    rules = [uf.Rule("a", "^common^rare^", "block"), uf.Rule("b", "^common^*^other^", "block"), uf.Rule("c", "*x*", "block")]
    rows = spark.createDataFrame([("h", "/common/other/")] * 5 + [("h", "/common/rare/other/")], "host string, path string")
    assert {t: [r.name for r in own] for t, own in uf.filed(rows, rules).items()} == {"rare": ["a"], "common": ["b"], "": ["c"]}
    assert any(len(uf.literal_tokens(r)) > 1 for r in uf.PATTERNS)


def test_folding_is_the_sql(df):
    pages = df.where("length(url) < 1000 OR url IS NULL").toPandas()
    with duckdb.connect() as c:
        c.register("pages", pages)
        want = {r[0]: r[1:] for r in c.sql(uf.oracle()).fetchall()}
    fixed = {r.name for r in uf.FIXED}
    for k, url in enumerate(URLS * 2):
        if url is None or len(url) < 1000:
            host, path, name, action = brute(url, uf.FIXED + uf.PATTERNS)
            assert want[k] == (host, path, name if name in fixed else None, action or "allow"), url


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    for most in (10**5, 0):
        uf_most, uf.MAX_BROADCAST = uf.MAX_BROADCAST, most
        try:
            assert uf.judged(none, uf.FIXED + uf.PATTERNS).count() == 0
        finally:
            uf.MAX_BROADCAST = uf_most


@pytest.mark.parametrize("most", [10**5, 0])
def test_kept_columns_may_be_called_anything(spark, monkeypatch, most):
    monkeypatch.setattr(uf, "MAX_BROADCAST", most)
    rows = [(k, u, k, "x", "y") for k, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, name long, token string, _r string")
    got = uf.judged(df, uf.FIXED + uf.PATTERNS, keep=("page_id", "url", "token", "_r")).collect()
    assert {(r["page_id"], r["url"], r["host"], r["action"]) for r in got} == {(k, u, brute(u, uf.FIXED + uf.PATTERNS)[0], brute(u, uf.FIXED + uf.PATTERNS)[3]) for k, u in enumerate(URLS)}


def test_many_rules_compile_only_when_fetched(spark):
    rules = [uf.Rule(f"r{k}", f"^word{k}^tail{k}^", "block") for k in range(50_000)]
    df = spark.range(30_000).selectExpr("id AS page_id", "concat('http://h/word', id % 60000, '/tail', id % 60000, '/') AS url").repartition(4)
    began = time.perf_counter()
    got = {r["page_id"]: r["name"] for r in uf.judged(df, rules).collect()}
    assert time.perf_counter() - began < 120
    assert all(got[k] == f"r{k}" for k in range(30_000))
