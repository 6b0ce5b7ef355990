"""Main text of web pages by wrapper induction.

A page becomes a tree of its structural elements; runs of like siblings are one
node, and so are runs of paragraphs, headings and lists ("#flow"). The tree's
outline is its skeleton. For each host the most frequent skeleton is the
reference, and every other skeleton of the host is aligned with it by simple
tree matching; each aligned node is a slot. Over the host's articles, a block
whose text stands in the same slot of most of them is template, whatever varies
is content.

How template is told from repeated text. Pages are counted by article, that is
by their first heading (or longest block), so copies of one article count once
and don't make it a template. Outside a marked article or main part a block is
template on LEAST articles or more and SHARE of those that fill the slot; and a
slot is template as a whole if SHARE of what fills it recurs on LEAST articles,
as with adverts or footers drawn from a pool. Inside one it takes LEAST_INSIDE and SHARE_INSIDE, since lines such as licences
recur in articles too.

Elements that the main text excludes by meaning (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, hidden parts) are told by
element, role and class name, whether they vary or not. Names are evidence only:
an element that holds the article, or most of the page's text, is never left out
for its name (see _verdicts). Inside an article only whole class names count,
never parts of hyphenated ones. A marked article is evidence, not a switch: it is
all that counts unless the rest of the page has more than REST times as much
content.

Skeletons, not pages, are aligned, so a host with a third of all pages costs no
more than its distinct skeletons; slot statistics are sums over (host, slot,
text hash, article), and joins deal out hot hosts and skeletons.

Defined results. Null and empty pages have an empty text. Hosts of fewer
articles than LEAST show no variation: nothing is template there and names alone
decide. Null urls and urls without "://" share the empty host. Repeated rows are
extracted each on its own. Elements nested deeper than MAX_DEPTH write to the
node at that depth, keeping their own roles; no text is lost by it. An empty
table gives an empty table. Only the id, url and html are read, so clashing
names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_spread, on_workers, table, written
from .url_filter import host_and_path

MAX_DEPTH = 100
#: Articles, and share of a slot's articles, that make a block template.
LEAST, SHARE = 3, 0.5
LEAST_INSIDE, SHARE_INSIDE = 8, 0.9
#: So many times a marked article's text must the rest have to count as well.
REST = 4
#: Cells of an alignment's table; larger ones are split in halves, which needs memory for two rows only.
MAX_CELLS, MAX_CACHED = 1 << 20, 1 << 15

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: A tag with a quotation mark that never closes ends at the next angle bracket.
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math canvas object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption address hr details summary hgroup center".split())
_STRUCTURE = frozenset("html head body div section article main header footer nav aside form menu dialog fieldset select button search".split())
_ROLE_TAGS = frozenset("head footer nav aside form menu dialog fieldset select button search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class names of what the main text excludes: menus, headers, footers, sidebars, notices, adverts, reader comments.
_NAMES = frozenset(
    "menu nav navbar navigation header masthead footer sidebar aside notice cookie cookies consent"
    " ad ads advert adverts advertisement advertising sponsored banner comment comments respond disqus".split()
)
_HEADINGS = frozenset("h1 h2 h3".split())
#: An opening tag ends these where they are still open.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_STOPS = frozenset("ul ol dl table".split())


class _Node:
    __slots__ = ("label", "depth", "kids", "index")

    def __init__(self, label: str, up: "_Node | None" = None):
        self.label, self.depth, self.index = label, up.depth + 1 if up else 0, 0
        self.kids: list[_Node] = []


#: How surely names say that an element stands beside the text.
_WEAK, _STRONG, _HIDDEN = 1, 2, 3
#: Share of a page's text from which an element isn't beside it, where no article is marked elsewhere.
MOST = 0.5


def _opened(tag: str, attributes: str, inside: bool) -> tuple[str, int, bool]:
    """Label of an element, how surely it has a role beside the text, whether it marks an article."""
    classes: list[str] = []
    role, hidden, body = "", False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            classes += value.split()
        elif name == "role":
            role = value.strip()
        elif name == "hidden":
            hidden = True
        elif name == "itemprop" and value == "articlebody":
            body = True
    marks = tag in ("article", "main") or role in ("main", "article") or body
    beside = _HIDDEN if hidden else _STRONG if tag in _ROLE_TAGS or role in _ROLES or tag == "header" and not inside else 0
    if classes and not beside and tag not in ("html", "body"):
        if not _NAMES.isdisjoint(classes):
            beside = _STRONG
        elif not inside and not marks and not _NAMES.isdisjoint(w for c in classes for w in re.split(r"[-_]+", c)):
            # Parts of names tell outside articles only: "site-footer", but not "share-price".
            beside = _WEAK
    label = f"{tag}.{'.'.join(sorted({re.sub(r'[0-9|~ ]', '', c) for c in classes}))}" if classes else re.sub(r"[|~ ]", "", tag)
    return label, beside, marks


class _Element:
    """An open element: what it is, and what its text amounts to."""

    __slots__ = ("tag", "label", "up", "beside", "marks", "inside", "heading", "mass", "marked", "out", "node")

    def __init__(self, tag: str, label: str, up: "_Element | None", beside: int, marks: bool):
        self.tag, self.label, self.up, self.beside, self.marks = tag, label, up, beside, marks
        self.inside = marks or up is not None and up.inside
        self.heading, self.mass, self.marked, self.out, self.node = False, 0, 0, False, None


class _Stack:
    """Open elements, and where those of each tag stand, so that none is searched for step by step."""

    def __init__(self, root: _Element):
        self.open, self.places, self.structure = [root], {}, []

    def push(self, element: _Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.open))
        if element.tag in _STRUCTURE:
            self.structure.append(len(self.open))
        self.open.append(element)

    def cut(self, k: int) -> None:
        for element in self.open[k:]:
            self.places[element.tag].pop()
            if element.tag in _STRUCTURE:
                self.structure.pop()
        del self.open[k:]

    def last(self, tags, stops=(), structure: bool = False) -> int:
        """Place of the innermost element of these tags, 0 if a stop (or structure) is nearer or there is none."""
        place = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=0)
        found = place(tags)
        barrier = max(place(stops), self.structure[-1] if structure and self.structure else 0)
        return found if found >= barrier else 0


def _verdicts(elements: list[_Element]) -> None:
    """Which elements stand beside the text.

    Names are evidence. An element that holds a marked article isn't beside the
    text if only a part of its name says so, or if no article is marked outside
    such elements; nor is one with most of the page's text where no article is
    marked elsewhere, nor a heading's frame that a part of its name calls a header.
    """
    loose = 0
    for e in elements:  # parents come first
        e.out = e.beside >= _STRONG or e.up is not None and e.up.out
    own_marked = {id(e): e.mass for e in elements if e.inside}
    for e in reversed(elements):
        mine = own_marked.get(id(e), 0)
        loose += 0 if e.out else mine
        e.marked += mine
        if e.up is not None:
            e.up.mass += e.mass
            # An element's own mark doesn't speak for it, as comments are marked as articles too.
            e.up.marked += e.marked
            e.up.heading |= e.heading
    total = elements[0].mass
    for e in elements:
        held = e.marked if not e.marks and not (e.up is not None and e.up.inside) else 0
        if not e.beside or e.beside == _HIDDEN:
            own = bool(e.beside)
        elif held:
            own = e.beside == _STRONG and loose > 0
        elif not loose and e.mass > MOST * total:
            own = False
        else:
            own = not (e.beside == _WEAK and e.heading and "header" in e.label)
        e.out = own or e.up is not None and e.up.out


def parse(html: str) -> tuple[_Node, list[tuple[str, _Node, bool, bool]]]:
    """The tree of structural elements, and blocks in page order: text, "#flow" node, in an article, heading.

    What has a role beside the text is left out of both. Time is in proportion to
    the page, whatever is broken in it.
    """
    top = _Element("#page", "#page", None, 0, False)
    stack, elements = _Stack(top), [top]
    events: list[tuple[_Element, str | None]] = []  # an element opens, or has a block of text
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            here = stack.open[-1]
            block = " ".join("".join(buffer).split())
            buffer.clear()
            if block:
                here.mass += len(block)
                here.heading |= here.tag == "h1"
                events.append((here, block))

    at, end, last_close = 0, len(html), html.rfind(">")
    while at < end:
        start = html.find("<", at)
        if start < 0 or start > last_close:
            buffer.append(unescape(html[at:]))
            break
        if html.startswith("<!--", start):
            m, after = None, html.find("-->", start + 4)
            after = end if after < 0 else after + 3
        elif html.startswith(("<!", "<?"), start):
            m, after = None, html.find(">", start) + 1
        else:
            m = _TAG.match(html, start) or _BROKEN.match(html, start)
            after = m.end() if m else start + 1
        if m is None and after == start + 1:
            buffer.append(unescape(html[at:after]))
            at = after
            continue
        if start > at:
            buffer.append(unescape(html[at:start]))
        at = after
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _FLOW or tag in _STRUCTURE:
                flush()
                if k := stack.last((tag,), structure=tag not in _STRUCTURE):
                    stack.cut(k)
            continue
        if tag in _RAW:
            # Up to its end tag, whatever stands there.
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                close = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(html, at)
                at = html.find(">", close.end()) + 1 if close else end
                at = at or end
            continue
        if tag == "br":
            buffer.append(" ")
        elif tag in _FLOW or tag in _STRUCTURE:
            flush()
            if k := stack.last(("p",), structure=True):
                stack.cut(k)
            if tag in _ENDS and (k := stack.last(_ENDS[tag], _STOPS if tag != "tr" else ("table",), structure=True)):
                stack.cut(k)
            if tag in _VOID:
                continue
            here = stack.open[-1]
            label, beside, marks = _opened(tag, m[3], here.inside) if m[3] or tag in _STRUCTURE else (tag, 0, False)
            element = _Element(tag, label, here, beside, marks)
            elements.append(element)
            if tag in _STRUCTURE:
                events.append((element, None))
            stack.push(element)
    flush()
    _verdicts(elements)
    return _tree(elements, events)


def _tree(elements: list[_Element], events: list[tuple[_Element, str | None]]) -> tuple[_Node, list[tuple[str, _Node, bool, bool]]]:
    """Nodes and blocks of what isn't beside the text."""
    root = elements[0].node = _Node("#page")
    blocks: list[tuple[str, _Node, bool, bool]] = []

    def node_of(element: _Element) -> _Node:
        chain = []
        while element.node is None:  # a flow element writes to its parent's node
            chain.append(element)
            element = element.up
        for e in chain:
            e.node = element.node
        return element.node

    for element, block in events:
        if element.out:
            continue
        if block is None:
            here = node_of(element.up)
            if here.depth < MAX_DEPTH:
                if not here.kids or here.kids[-1].label != element.label:
                    here.kids.append(_Node(element.label, here))
                here = here.kids[-1]
            element.node = here
        else:
            here = node_of(element)
            if not here.kids or here.kids[-1].label != "#flow":
                here.kids.append(_Node("#flow", here))
            blocks.append((block, here.kids[-1], element.inside, element.tag in _HEADINGS))
    return root, blocks


def flat(root: _Node) -> str:
    """Skeleton: depth and label of each node in page order; sets the nodes' places in it."""
    entries: list[str] = []

    def visit(node: _Node) -> None:
        node.index = len(entries)
        entries.append(f"{node.depth}~{node.label}")
        for kid in node.kids:
            visit(kid)

    visit(root)
    return "|".join(entries)


def article_of(blocks: list[tuple[str, _Node, bool, bool]]) -> str:
    """What tells a page's article from others: its first heading, one in an article first, else its longest block."""
    headings = [(not inside, k) for k, (_, _, inside, heading) in enumerate(blocks) if heading]
    return blocks[min(headings)[1]][0] if headings else max((b[0] for b in blocks), key=len, default="")


class _Trees:
    """Two skeletons, their subtrees numbered so that equal ones share a number."""

    def __init__(self, *skeletons: str):
        self.known: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.kids, self.number = zip(*map(self._read, skeletons), strict=True)

    def _read(self, skeleton: str) -> tuple[list[list[int]], list[int]]:
        rows = [e.split("~", 1) for e in skeleton.split("|")]
        kids: list[list[int]] = [[] for _ in rows]
        path: list[int] = []
        for k, (depth, _) in enumerate(rows):
            del path[int(depth) :]
            if path:
                kids[path[-1]].append(k)
            path.append(k)
        number = [0] * len(rows)
        for k in range(len(rows) - 1, -1, -1):
            key = (rows[k][1], *(number[j] for j in kids[k]))
            if key not in self.known:
                self.known[key] = len(self.labels)
                self.labels.append(rows[k][1])
                self.parts.append(np.array(key[1:], np.int64))
                self.sizes.append(1 + sum(self.sizes[j] for j in key[1:]))
            number[k] = self.known[key]
        return kids, number

    def weight(self, x: int, y: int) -> int:
        """Nodes of the best matching of two subtrees."""
        if x == y:
            return self.sizes[x]
        if self.labels[x] != self.labels[y]:
            return 0
        if (x, y) not in self.weights:
            self.weights[x, y] = 1 + int(self.rows(self.parts[x], self.parts[y])[-1])
        return self.weights[x, y]

    def rows(self, a: np.ndarray, b: np.ndarray, table: list | None = None) -> np.ndarray:
        """Last row of the table of best matchings of the lists' beginnings; all rows go to table."""
        row = np.zeros(len(b) + 1, np.int64)
        kinds, of = np.unique(b, return_inverse=True)
        weights: dict[int, np.ndarray] = {}
        if table is not None:
            table.append(row)
        for x in a.tolist():
            if x not in weights:
                weights[x] = np.array([self.weight(x, y) for y in kinds.tolist()], np.int64)[of]
            new = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[x]), out=new[1:])
            row = new
            if table is not None:
                table.append(row)
        return row

    def pairs(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Places of the elements that the best matching of two lists pairs."""
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
        n -= head
        differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        tail = int(differ[0]) if len(differ) else n
        out = [(k, k) for k in range(head)] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if not len(a) or not len(b):
            return out
        if len(a) > 1 and len(a) * len(b) > MAX_CELLS:
            half = len(a) // 2
            both = self.rows(a[:half], b) + self.rows(a[half:][::-1], b[::-1])[::-1]
            cut = int(both.argmax())
            mine = self.pairs(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in self.pairs(a[half:], b[cut:])]
        else:
            table: list[np.ndarray] = []
            self.rows(a, b, table)
            i, j, mine = len(a), len(b), []
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    mine.append((i, j))
        return out + [(i + head, j + head) for i, j in mine]


def _aligned(skeleton: str, reference: str) -> list[int]:
    trees = _Trees(skeleton, reference)
    kids_a, kids_b = trees.kids
    number_a, number_b = trees.number
    out = [-1] * len(number_a)
    open_ = [(0, 0)]
    while open_:
        x, y = open_.pop()
        if number_a[x] == number_b[y]:
            for k in range(trees.sizes[number_a[x]]):
                out[x + k] = y + k
            continue
        out[x] = y
        pairs = trees.pairs(trees.parts[number_a[x]], trees.parts[number_b[y]])
        open_ += [(kids_a[x][i], kids_b[y][j]) for i, j in pairs]
    return out


_cached = lru_cache(maxsize=4096)(_aligned)


def aligned(skeleton: str, reference: str) -> list[int]:
    """For each node the node of the reference it matches, or -1: simple tree matching."""
    return (_cached if len(skeleton) + len(reference) <= MAX_CACHED else _aligned)(skeleton, reference)


def parsed(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, host, skeleton, article, blocks, nodes, inside, hashes) of every page, parsed once."""
    on_workers(df.sparkSession)
    digest = lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)

    @F.pandas_udf("skeleton string, article long, blocks array<string>, nodes array<int>, inside array<boolean>, hashes array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page in pages:
                root, blocks = parse(page)
                skeleton = flat(root)
                texts = [b[0] for b in blocks]
                rows.append((skeleton, digest(article_of(blocks)), texts, [b[1].index for b in blocks], [b[2] for b in blocks], [digest(t) for t in texts]))
            yield pd.DataFrame(rows, columns=["skeleton", "article", "blocks", "nodes", "inside", "hashes"])

    tree = of(F.coalesce(F.col(html), F.lit(""))).alias("_t")
    return df.select(F.col(id), F.col(url), host_and_path(F.col(url))[0].alias("host"), tree).select(id, url, "host", "_t.*")


def wrappers(trees: DataFrame) -> DataFrame:
    """trees (stored) to (host, skeleton, places, template, _rows): slots of a skeleton's nodes, and keys of the host's template blocks."""
    on_workers(trees.sparkSession)

    @F.pandas_udf("array<int>")
    def align(skeletons: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([aligned(a, b) for a, b in zip(skeletons, references, strict=True)], dtype=object)

    shapes = written(trees.groupBy("host", "skeleton").agg(F.count("*").alias("_rows")).withColumnRenamed("_rows", "n"))
    hosts = written(shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("reference"), F.count("*").alias("_rows")))
    placed = written(joined_spread(shapes, hosts, ["host"]).select("host", "skeleton", align("skeleton", "reference").alias("places"), F.col("n").alias("_rows")))
    blocks = joined_spread(trees.select("host", "skeleton", "article", "nodes", "inside", "hashes"), placed, ["host", "skeleton"])
    blocks = blocks.select("host", "article", "places", F.explode(F.arrays_zip("nodes", "inside", "hashes")).alias("b"))
    blocks = blocks.select("host", "article", F.get("places", F.col("b.nodes")).alias("slot"), "b.inside", F.col("b.hashes").alias("hash")).where("slot >= 0")
    fills = blocks.distinct()
    by_block = fills.groupBy("host", "slot", "inside", "hash").agg(F.count("*").alias("n"))
    by_slot = fills.select("host", "slot", "inside", "article").distinct().groupBy("host", "slot", "inside").agg(F.count("*").alias("articles"))
    pooled = by_block.where(~F.col("inside")).groupBy("host", "slot", "inside").agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("n") >= LEAST, F.col("n")).otherwise(0)).alias("_again"))
    pooled = pooled.where(F.col("_again") >= SHARE * F.col("_all")).select("host", F.xxhash64("slot", "inside", F.lit(0).cast("long")).alias("key"))
    often = by_block.where(F.col("n") >= LEAST).join(by_slot.where(F.col("articles") >= LEAST), ["host", "slot", "inside"])
    constant = F.when(F.col("inside"), (F.col("n") >= LEAST_INSIDE) & (F.col("n") >= SHARE_INSIDE * F.col("articles"))).otherwise(F.col("n") >= SHARE * F.col("articles"))
    keys = often.where(constant).select("host", F.xxhash64("slot", "inside", "hash").alias("key")).unionByName(pooled)
    # At most a page's blocks over SHARE for each slot, and the slot itself.
    template = keys.groupBy("host").agg(F.collect_set("key").alias("template"))
    per_host = written(hosts.join(template, "host", "left").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"), "_rows"))
    return joined_spread(placed.withColumnRenamed("_rows", "n"), per_host, ["host"]).withColumnRenamed("n", "_rows")


def extracted(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", induce: bool = True) -> DataFrame:
    """(id, url, text) of every row of df; without induction roles and marks alone decide."""
    trees = written(parsed(df, id, url, html))
    if induce:
        trees = joined_spread(trees, written(wrappers(trees)), ["host", "skeleton"])
    else:
        trees = trees.withColumn("template", F.array().cast("array<long>")).withColumn("places", F.array().cast("array<int>"))
    key = lambda b, text: F.xxhash64(F.get("places", b["nodes"]), b["inside"], text)
    varies = lambda b: ~F.array_contains("template", key(b, b["hashes"])) & ~F.array_contains("template", key(b, F.lit(0).cast("long")))
    mass = lambda inside: F.aggregate("_kept", F.lit(0).cast("long"), lambda n, b: n + F.when(b["inside"] == inside, F.char_length(b["blocks"])).otherwise(0))
    kept = trees.withColumn("_kept", F.filter(F.arrays_zip("blocks", "nodes", "inside", "hashes"), varies))
    main = F.when((mass(True) > 0) & (REST * mass(True) >= mass(False)), F.filter("_kept", lambda b: b["inside"])).otherwise(F.col("_kept"))
    return kept.select(id, url, F.array_join(F.transform(main, lambda b: b["blocks"]), "\n\n").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: main text of every page and its length."""
    return extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
