"""Wrapper induction: tree matching by brute force, what the template decides, hard pages."""

import importlib
import time
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

hx = importlib.import_module("samplewright.llm.html_extract")


def random_skeleton(rng, n):
    rows, depth = ["0~#page"], 0
    for _ in range(n):
        depth = int(rng.integers(1, min(depth + 1, 5) + 1))
        rows.append(f"{depth}~{rng.choice(['div', 'p', 'div.a'])}")
    return "|".join(rows)


def tree(skeleton):
    rows = [e.split("~") for e in skeleton.split("|")]
    kids, path = [[] for _ in rows], []
    for k, (d, _) in enumerate(rows):
        del path[int(d) :]
        if path:
            kids[path[-1]].append(k)
        path.append(k)
    return [r[1] for r in rows], kids


def best(a, b):
    """Size of the largest order-preserving matching of two trees, top down, by recursion."""
    (la, ka), (lb, kb) = tree(a), tree(b)

    @lru_cache(None)
    def node(x, y):
        return 1 + lists(tuple(ka[x]), tuple(kb[y])) if la[x] == lb[y] else 0

    @lru_cache(None)
    def lists(xs, ys):
        if not xs or not ys:
            return 0
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), (node(xs[0], ys[0]) or -1) + lists(xs[1:], ys[1:]))

    return node(0, 0)


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_alignment_is_the_best_matching(cells, monkeypatch):
    monkeypatch.setattr(hx, "MAX_CELLS", cells)
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = random_skeleton(rng, int(rng.integers(0, 18))), random_skeleton(rng, int(rng.integers(0, 18)))
        places = hx._aligned(a, b)
        (la, ka), (lb, kb) = tree(a), tree(b)
        up = lambda kids: {j: k for k, own in enumerate(kids) for j in own}
        ua, ub = up(ka), up(kb)
        used = [(x, y) for x, y in enumerate(places) if y >= 0]
        assert len({y for _, y in used}) == len(used) == best(a, b)
        assert all(la[x] == lb[y] and (x == 0 or places[ua[x]] == ub[y]) for x, y in used)
        assert used == sorted(used, key=lambda p: p[1])


def test_very_long_pages_in_bounded_time():
    began = time.perf_counter()
    a = "0~#page|" + "|".join(f"1~{'div' if k % 2 else 'section'}" for k in range(20000))
    b = "0~#page|1~section|2~div|" + "|".join(f"1~{'div' if k % 3 else 'section'}" for k in range(15000))
    places = hx.aligned(a, b)
    assert sum(y >= 0 for y in places) > 13000
    assert hx.aligned("0~#page|" + "1~div|" * 50000 + "1~p", "0~#page|" + "1~div|" * 50000 + "1~ul")[:50001] == list(range(50001))
    assert time.perf_counter() - began < 60


def texts(spark, rows, **options):
    df = spark.createDataFrame([(k, u, h, "clash", "clash") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, template string")
    out = hx.extracted(df, **options)
    assert out.columns == ["page_id", "url", "text"]
    return {r["page_id"]: r["text"] for r in out.collect()}


def test_template_decides_outside_and_inside_articles(spark):
    page = "<body><div class=promo>Read our app</div>{0}<div class=more>Join the list</div></body>"
    article = "<article><h1>Title {0}</h1><p>Text {0} goes on</p><p>Licensed to all</p><p>Sent from our desk</p></article>"
    body = lambda k: article.format(k).replace("<p>Licensed to all</p>", "" if k % 3 else "<p>Licensed to all</p>")
    rows = [("http://a/", page.format(body(k))) for k in range(12)] + [("http://b/", page.format(f"<div class=t><h1>T{k}</h1><p>Text {k}</p></div>")) for k in range(4)]
    got, off = texts(spark, rows), texts(spark, rows, induce=False)
    for k in range(12):
        licence = "" if k % 3 else "\n\nLicensed to all"
        assert got[k] == f"Title {k}\n\nText {k} goes on{licence}"  # a line on a third of the articles stays, the desk's on all of them goes
        assert off[k] == got[k] + "\n\nSent from our desk"
    for k in range(4):
        assert got[12 + k] == f"T{k}\n\nText {k}"
        assert off[12 + k] == f"Read our app\n\nT{k}\n\nText {k}\n\nJoin the list"


def test_slots_filled_from_a_pool_are_template(spark):
    page = "<body><div class=box>Offer {0}</div><div class=t><h1>T{1}</h1><p>Text {1}</p></div></body>"
    got = texts(spark, [("http://a/", page.format(k % 6, k)) for k in range(30)])
    assert [got[k] for k in range(30)] == [f"T{k}\n\nText {k}" for k in range(30)]


def test_copies_are_no_template(spark):
    same = "<body><div class=t><h1>One</h1><p>The same text</p></div></body>"
    near = same.replace("same", "very same")
    other = "<body><div class=t><h1>Other</h1><p>Else</p></div></body>"
    got = texts(spark, [("http://a/", same)] * 40 + [("http://a/", near)] * 40 + [("http://a/", other)])
    assert {got[k] for k in range(40)} == {"One\n\nThe same text"} and got[50] == "One\n\nThe very same text" and got[80] == "Other\n\nElse"


def test_articles_are_evidence_not_a_switch(spark):
    cards = "".join(f"<article class=teaser><h3>Card {k}</h3></article>" for k in range(3))
    got = texts(spark, [("http://a/", f"<div class=story><h1>Story</h1><p>{'Long text. ' * 20}</p></div>{cards}"), ("http://b/", "<p>Aside</p><main><h1>M</h1><p>Main text here</p></main>")])
    assert got[0].startswith("Story\n\nLong text.") and got[1] == "M\n\nMain text here"


def test_roles_by_name(spark):
    inside = "<div class='share-price'>Up 3</div><div class='ad-hoc-news'>News</div><p class=advert>Buy</p><ul class=menu><li>Home</ul><p hidden>Secret</p><div class=social>Talk</div>"
    deep = "<div>" * 105 + "<nav><p>menu</p></nav><article><h1>D</h1><p>deep</p></article>" + "</div>" * 105
    rows = [("http://a/", f"<article><h1>T</h1>{inside}</article>"), ("http://b/", deep), ("http://c/", "<div class=site-footer>F</div><p>Text</p><div id=comments><p>No</p></div>")]
    got = texts(spark, rows)
    assert (got[0], got[1], got[2]) == ("T\n\nUp 3\n\nNews\n\nTalk", "D\n\ndeep", "Text")


def test_odd_pages(spark):
    rows = [(None, None), ("x", ""), ("http://a/", None), ("http://c/", "plain < text"), (None, "<p>A&amp;B\n c</p>" * 3), ("http://d/", "<p>" + "word " * 200_000)]
    got = texts(spark, rows + rows[3:4])
    assert [got[k] for k in (0, 1, 2, 3, 4, 6)] == ["", "", "", "plain < text", "A&B c\n\nA&B c\n\nA&B c", "plain < text"]
    assert got[5] == ("word " * 200_000).strip()


def test_what_holds_the_article_is_no_aside(spark):
    """Names of containers, on a single page and where a host's pages all have them."""
    pages = {
        "<div class='container has-sidebar'><article><h1>T{0}</h1><p>Own text {0}.</p></article></div>": "T{0}\n\nOwn text {0}.",
        "<form id=aspnetForm><article><h1>T{0}</h1><p>Own text {0}.</p></article></form>": "T{0}\n\nOwn text {0}.",
        "<div id=main-nav-content><p>Own text {0}.</p></div>": "Own text {0}.",
        "<div class='ad-free layout'><main><p>Own text {0}.</p></main></div>": "Own text {0}.",
        "<section class='page header'><article><p>Own text {0}.</p></article></section>": "Own text {0}.",
        "<div class=page-header><h1>Title {0}</h1></div><p>Own text {0} which goes on.</p>": "Title {0}\n\nOwn text {0} which goes on.",
        "<nav>Menu of the site</nav><article><p>Own text {0}.</p></article><div class=comments><article><p>A comment {0} that is longer.</p></article></div>": "Own text {0}.",
        "<div class=sidebar><p>A sidebar that is much longer than the article {0}.</p></div><article><p>Own {0}.</p></article>": "Own {0}.",
        "<div hidden><article><p>Hidden {0}.</p></article></div><p>Shown {0}.</p>": "Shown {0}.",
    }
    rows = [(f"http://h{h}/", page.format(k)) for h, page in enumerate(pages) for k in range(5)] + [(f"http://one{h}/", page.format("x")) for h, page in enumerate(pages)]
    got = texts(spark, rows)
    want = [text.format(k) for text in pages.values() for k in range(5)] + [text.format("x") for text in pages.values()]
    assert [got[k] for k in range(len(rows))] == want


def test_broken_pages_take_time_in_proportion():
    """Pages of about a megabyte that never close what they open, or close what they never opened."""
    pages = ["<a " * 400_000, "<div>" * 90_000 + "</section>" * 60_000, "<div><td><div>" + "<ul>" * 120_000 + "</td>" * 100_000, "<a \"" * 300_000, "<a \"x' >" * 150_000, "<script></script " * 60_000, "<" * 1_000_000, "<!--" * 250_000, "<li>" * 250_000]
    for page in pages:
        began = time.perf_counter()
        hx.flat(hx.parse(page)[0])
        hx.flat(hx.parse(page + ">")[0])
        assert time.perf_counter() - began < 30
    assert [b[0] for b in hx.parse("a <b class=\"x> y</b> <p>z</p>")[1]] == ["a y", "z"]


def by_hand(rows):
    """Induction without Spark: rows (host, html) to texts."""
    trees = []
    for host, html in rows:
        root, blocks = hx.parse(html or "")
        trees.append((host, hx.flat(root), hx.article_of(blocks), blocks))
    out, fills = [], defaultdict(set)
    shapes = Counter((host, skeleton) for host, skeleton, _, _ in trees)
    reference = {h: max((n, s) for (g, s), n in shapes.items() if g == h)[1] for h, _ in shapes}
    for host, skeleton, article, blocks in trees:
        places = hx.aligned(skeleton, reference[host])
        for text, node, inside, _ in blocks:
            if places[node.index] >= 0:
                fills[host, places[node.index], inside].add((article, text))
    template, pooled = set(), set()
    for (host, slot, inside), own in fills.items():
        n, articles = Counter(t for _, t in own), len({a for a, _ in own})
        least, share = (hx.LEAST_INSIDE, hx.SHARE_INSIDE) if inside else (hx.LEAST, hx.SHARE)
        template |= {(host, slot, inside, t) for t, c in n.items() if articles >= hx.LEAST and c >= max(least, hx.LEAST) and c >= share * articles}
        if not inside and sum(c for c in n.values() if c >= hx.LEAST) >= hx.SHARE * sum(n.values()):
            pooled.add((host, slot, inside))
    for host, skeleton, _, blocks in trees:
        places = hx.aligned(skeleton, reference[host])
        kept = [(t, inside) for t, node, inside, _ in blocks if (host, places[node.index], inside, t) not in template and (host, places[node.index], inside) not in pooled]
        mass = {i: sum(len(t) for t, inside in kept if inside == i) for i in (True, False)}
        main = [t for t, inside in kept if inside] if mass[True] and hx.REST * mass[True] >= mass[False] else [t for t, _ in kept]
        out.append("\n\n".join(main))
    return out


def test_query_is_induction_by_hand(spark):
    rng, rows = np.random.default_rng(11), []
    frames = ["<body><div class=x>{a}</div>{b}<div class=y><p>{c}</p></div></body>", "<body>{b}<div class=x>{a}</div></body>", "<section><div class=x>{a}</div><div class=z>{c}</div>{b}</section>"]
    bodies = ["<article><h1>{t}</h1><p>{u}</p><p>{c}</p></article>", "<div class=t><h2>{t}</h2><p>{u}</p></div>", "<p>{u}</p>", "<article><p>{u}</p></article><article class=comment><p>{c}</p></article>"]
    for host, n in (("h0", 40), ("h1", 15), ("h2", 7), ("h3", 2), ("", 6)):
        for _ in range(n):
            pool = [f"pooled {k}" for k in rng.integers(0, 4, 2)]
            body = bodies[rng.integers(len(bodies))].format(t=f"T{rng.integers(30)}", u=f"unique {rng.integers(1000)} words", c=pool[0])
            rows.append((host, frames[rng.integers(len(frames))].format(a=pool[1], b=body, c=f"{host} notice")))
    rows += [rows[0]] * 30 + [("h4", None)]
    want = by_hand(rows)
    got = texts(spark, [(f"http://{h}/p" if h else None, html) for h, html in rows])
    assert [got[k] for k in range(len(rows))] == want
    assert want != [t for t in texts(spark, [(f"http://{h}/p" if h else None, html) for h, html in rows], induce=False).values()]
