"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks of text. The nodes of the graph are the blocks and the elements around them. A classifier
gives each node a cost for either label, which becomes the capacity to a terminal: of a block by its own text (words,
links, sentence ends), of an element by its tag and names; most elements say nothing. Smoothness edges join what is
near in the tree (each node and the element around it) and blocks that follow each other. The maximum flow separates
content from boilerplate at the least total cost. Nodes whose own cost outweighs all their edges are settled
beforehand, which leaves small flows. So a short line belongs to the article that it stands in, a sentence to
the advert that it stands in, and without such elements to what is around it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Never text, with all that they hold. Their raw contents end at their own end tag, or with the page.
RAW = frozenset(("script", "style", "noscript", "iframe", "title", "xmp", "noembed", "noframes"))
#: Never text either, but only up to an end tag that is there: of one that closes itself, or is never closed, the tag alone is left out.
HIDDEN = frozenset(("template", "object", "svg", "canvas", "audio", "video", "annotation", "annotation-xml"))
OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
#: A tag without quotes, which most are; else its name, and then what ends it or begins a quoted value.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)([^<>\"']*)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: What an opening tag ends, if it is the nearest open one of these within its container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MAIN_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav aside footer form menu button select option textarea fieldset label input dialog search address".split())
#: Of these tags, and of names, one that holds most of a page without an article is no sign of boilerplate.
WRAPPERS = frozenset(("form", "fieldset", "label"))
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: Parts of names (class, id, role, label) that are boilerplate, those that only may be, and those of content.
BOILER_NAMES = frozenset(
    "ad ads advert advertisement aside alert social search advertising adbox banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing comment comments commentlist reply replies disqus respond related recommended recommendations widget widgets pagination pager tagcloud copyright disclaimer skip".split()
)
DOUBTFUL_NAMES = frozenset("side foot discussion more tags legal form header".split())
MAIN_NAMES = frozenset("article content post entry story main body text prose maincontent".split())
SPLIT = re.compile(r"[^a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"\S+")
SPACE = re.compile(r"\s+")
SENTENCE_END = re.compile(r"[.!?…。！？]")

#: Log-odds of content of a block: of any, per doubling of words (up to 6), at full link density, of a sentence end, of a heading; clipped at MOST_ODDS.
BASE, LENGTH, LINKS, SENTENCE, HEADING, MOST_ODDS = -1.5, 0.45, -3.0, 0.8, 0.8, 2.0
#: Of an element: for each block below one with a tag or name that says what it is (more than any block has), and of one whose name only may.
SURE, DOUBTFUL = 3.0, 1.5
#: Smoothness: to the element around, below one that says what it is (more than a block's odds and its neighbours), else from a block, and from
#: an element, which has more to say by itself; between blocks in a row in one element.
HELD, NEAR, FAR, ADJACENT = 2.6, 0.8, 0.3, 0.25


class Element:
    __slots__ = ("boiler", "doubt", "kind", "main", "named", "parent", "tag", "under", "words")

    def __init__(self, tag: str, parent: Element | None) -> None:
        self.tag, self.parent, self.words = tag, parent, 0
        self.main, self.boiler, self.named, self.doubt = tag in MAIN_TAGS, tag in BOILER_TAGS, False, 0.0
        self.kind, self.under = 0, False


class Block:
    __slots__ = ("linked", "parent", "text", "words")

    def __init__(self, text: str, parent: Element, words: int, linked: int) -> None:
        self.text, self.parent, self.words, self.linked = text, parent, words, linked


def element(tag: str, attributes: str, parent: Element) -> Element:
    e = Element(tag, parent)
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id", "role", "aria-label"):
                parts = {*SPLIT.split(HUMP.sub("-", value).lower()), *SPLIT.split(value.lower())}
                e.named |= not parts.isdisjoint(BOILER_NAMES)
                e.doubt += DOUBTFUL * ((not parts.isdisjoint(MAIN_NAMES)) - (not parts.isdisjoint(DOUBTFUL_NAMES)))
                if name == "role":
                    e.boiler |= value.lower() in BOILER_ROLES
                    e.main |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                e.boiler = True
    return e


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is it an end tag, name in lower case, attributes) of each tag in order, with "" as the name of comments and declarations.

    RAW elements are one such piece with all that they hold, up to the end of the page if they don't end. What a
    comment, a declaration or a quoted value without an end is cut off at is found in one pass: a quote that leaves the
    tag without an end is none, and neither are later ones.
    """
    at, quotes, ends = 0, True, True
    while ends and (m := OPENS.search(page, at)):
        start = m.start()
        if m[0] in ("<!--", "<![CDATA["):
            end = page.find("-->" if m[0] == "<!--" else "]]>", m.end())
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, "", ""
            continue
        if m[0] in ("<!", "<?"):
            at = page.find(">", start) + 1
            ends = at > 0
            if ends:
                yield start, at, False, "", ""
            continue
        if plain := PLAIN_TAG.match(page, start):
            at, closing, name, attributes = plain.end(), plain[1] == "/", plain[2].lower(), plain[3]
        else:
            named = NAME.match(page, start)
            at, end = named.end(), -1
            while quotes and (q := QUOTED.search(page, at)):
                if q[0] == ">":
                    end = q.start()
                    break
                if (at := page.find(q[1], q.end()) + 1) == 0:
                    break
            if end < 0:
                quotes, end = False, page.find(">", named.end())
                if end < 0:
                    return
            closing, name, attributes, at = page[start + 1] == "/", named[1].lower(), page[named.end() : end], end + 1
        if name in RAW and not closing:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
            yield start, at, False, "", ""
        else:
            yield start, at, closing, name, attributes


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks in order, and all elements, each after the one around it. Markup, comments, RAW and HIDDEN elements leave no text; wrong nesting is mended as browsers do, roughly."""
    root = Element("", None)
    stack, elements = [root], [root]
    containers = [0]  # where block elements stand in the stack
    open_tags: Counter[str] = Counter()
    blocks: list[Block] = []
    parts: list[str] = []
    linked_parts: list[str] = []

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                words = len(WORDS.findall(text))
                linked = sum(len(WORDS.findall(p)) for p in linked_parts)
                at = stack[containers[-1]]
                blocks.append(Block(text, at, words, min(linked, words)))
                at.words += words
            parts.clear()
            linked_parts.clear()

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if open_tags["a"]:
                linked_parts.append(plain)

    def pop_to(n: int) -> None:
        while len(stack) > n:
            open_tags[stack.pop().tag] -= 1
        while containers[-1] >= n:
            containers.pop()

    at, skipping, unclosed = 0, 0, set()
    for start, end, closing, tag, attributes in tags(page):
        if start < skipping:
            continue
        text(page[max(at, skipping) : start])
        at = end
        if not tag:
            continue
        if closing:
            if tag in BLOCKS or tag == "br":
                flush()
            if open_tags[tag]:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in HIDDEN:
            # A tag that has no end from here on has none later: the page isn't searched for it again.
            last = None if attributes.endswith("/") or tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, end)
            if last:
                skipping = last.end()
            elif not attributes.endswith("/"):
                unclosed.add(tag)
            continue
        if tag == "br":
            flush()
        if tag in BLOCKS:
            flush()
            if stack[containers[-1]].tag == "p":
                pop_to(containers[-1])
            if tag in CLOSES and any(open_tags[t] for t in CLOSES[tag][0]):
                ended, within = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        pop_to(k)
                        break
                    if stack[k].tag in within:
                        break
        if tag not in VOID and (tag in BLOCKS or not attributes.endswith("/")):
            if tag in BLOCKS:
                containers.append(len(stack))
            stack.append(element(tag, attributes, stack[-1]))
            elements.append(stack[-1])
            open_tags[tag] += 1
    text(page[max(at, skipping) :])
    flush()
    return blocks, elements


def block_odds(b: Block) -> float:
    """Log-odds that the block is content, by its own text."""
    score = BASE + LENGTH * min(6.0, math.log2(1 + b.words)) + LINKS * (b.linked / b.words) + HEADING * (b.parent.tag in HEADINGS)
    return max(-MOST_ODDS, min(MOST_ODDS, score + SENTENCE * (SENTENCE_END.search(b.text) is not None)))


def judge(elements: list[Element]) -> None:
    """Sets each element's kind, which is what its tag and names say for sure: content 1, boilerplate -1, else 0; and whether something around it says so."""
    total = sum(e.words for e in elements)
    for e in reversed(elements):  # words of all that an element holds
        if e.parent is not None:
            e.parent.words += e.words
    within: dict[int, bool] = {}  # of each element, is something around it boilerplate by tag or name?
    article = False
    for e in elements:
        within[id(e)] = inside = e.parent is not None and (within[id(e.parent)] or e.parent.boiler or e.parent.named)
        article |= e.main and not (inside or e.named or e.boiler)
    for e in elements:
        around = e.parent
        most = not article and e.words > 0.5 * total
        if e.main:
            # Comments and teasers are articles of their own, unless they are all that there is.
            e.kind = -1 if article and (within[id(e)] or e.named) or e.boiler and not most else 1
        elif e.boiler and not (most and e.tag in WRAPPERS) or e.named and not most:
            e.kind = -1
        elif e.tag == "header" and not (around and (around.under or around.kind) and _content(around)):
            e.kind = -1
        e.under = around is not None and (around.under or around.kind != 0)


def _content(e: Element | None) -> bool:
    """Is the nearest element that says what it is content?"""
    while e is not None and not e.kind:
        e = e.parent
    return e is not None and e.kind > 0


def graph(blocks: list[Block], elements: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of all nodes, the blocks first, and the edges (node, node, capacity). Elements that say nothing and hold one node are no nodes."""
    judge(elements)
    unary = [block_odds(b) for b in blocks]
    edges: list[tuple[int, int, float]] = []
    inside: dict[int, list[int]] = defaultdict(list)
    size: dict[int, int] = defaultdict(int)
    for k, b in enumerate(blocks):
        inside[id(b.parent)].append(k)
        size[id(b.parent)] += 1
    top = [-1] * len(blocks)  # the element that a block is joined to
    for e in reversed(elements):
        nodes = inside.pop(id(e), [])
        if not nodes:
            continue
        if e.kind or e.doubt or len(nodes) > 1:
            for k in nodes:
                edges.append((k, len(unary), HELD if e.kind or e.under else NEAR if k < len(blocks) else FAR))
                if k < len(blocks):
                    top[k] = len(unary)
            nodes = [len(unary)]
            unary.append(e.kind * SURE * (size[id(e)] + 1) + e.doubt)
        if e.parent is not None:
            inside[id(e.parent)] += nodes
            size[id(e.parent)] += size[id(e)]
    edges += [(k - 1, k, ADJACENT) for k in range(1, len(blocks)) if top[k] == top[k - 1]]
    return unary, edges


def settled(unary: list[float], edges: list[tuple[int, int, float]]) -> tuple[list[bool | None], list[float], list[list[tuple[int, float]]]]:
    """Labels of nodes whose odds outweigh their open edges, one after another; the odds of all, those settled counted in; and each node's edges."""
    n = len(unary)
    theta, around = list(unary), [[] for _ in range(n)]
    for a, b, w in edges:
        if w > 0:
            around[a].append((b, w))
            around[b].append((a, w))
    open_w = [sum(w for _, w in x) for x in around]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(theta[k]) >= open_w[k] - 1e-12:
            label[k] = theta[k] > 0
            for j, w in around[k]:
                if label[j] is None:
                    theta[j] += w if label[k] else -w
                    open_w[j] -= w
                    queue.append(j)
    return label, theta, around


def max_flow(theta: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow, by blocking flows along shortest paths. theta: capacity from the source, or (negative) to the sink."""
    n = len(theta)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]
    for a, b, forth, back in [(source, k, t, 0.0) if t > 0 else (k, sink, -t, 0.0) for k, t in enumerate(theta)] + [(a, b, w, w) for a, b, w in edges]:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += (b, a)
        cap += (forth, back)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        arc, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                a = to[path[cut] ^ 1]
                del path[cut:]
            elif arc[a] < len(out[a]):
                e = out[a][arc[a]]
                if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    arc[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                arc[a] += 1
            else:
                break


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (content: True) of least cost: |unary[k]| for going against a node's odds, w for each edge that is cut. Ties go to boilerplate, as far as a tie isn't settled first."""
    label, theta, around = settled(unary, edges)
    rest = [k for k, x in enumerate(label) if x is None]
    at = {k: i for i, k in enumerate(rest)}
    if rest:
        open_edges = [(at[k], at[j], w) for k in rest for j, w in around[k] if j > k and j in at]
        for k, x in zip(rest, max_flow([theta[k] for k in rest], open_edges), strict=True):
            label[k] = x
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    """The page's main text: its content blocks, each with white space collapsed, joined by one space. Null is empty."""
    blocks, elements = parsed(page) if page else ([], [])
    labels = min_cut(*graph(blocks, elements))
    return " ".join(b.text for b, keep in zip(blocks, labels, strict=False) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages have the empty text, as have pages of boilerplate alone. Ids and urls may be null or repeat;
    an empty table gives an empty result; other columns are ignored. The whole page is read, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLE_SQL: dict[str, str] = {}
