import html.parser
import itertools
import random
import time

import pytest

from fathom.llm import html_extract as hx


def cost(labels, unary, edges):
    return sum(-u if keep else 0 for u, keep in zip(unary, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_min_cut_has_the_least_cost_of_all_labellings():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        best = min(cost(x, unary, edges) for x in itertools.product((False, True), repeat=n))
        assert cost(hx.min_cut(unary, edges), unary, edges) == pytest.approx(best)


PROSE = "This is a long sentence of the article, with enough words in it to be one. "
PAGE = f"""<!doctype html><html><head><title>No</title><style>p{{a:b}}</style></head><body class="post">
<header><h2>Site name</h2><form><label>Search</label><input value="x"></form></header>
<nav><ul><li><a href="/">Home</a><li><a href="/a">About</a></ul></nav>
<div class="cookie-notice"><p>{PROSE}</p></div>
<aside class="sidebar"><p>{PROSE}</p></aside>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>word {PROSE}<script>var a = "<p>no</p>";</script>
<p>Second&nbsp;one<br>next   line<!-- <p>no</p> --><div class="advert">Buy now. {PROSE}</div><p>Third: {PROSE}</p></article>
<section id="comments"><h3>Comments</h3><p>I think: {PROSE}</p></section>
<footer><p>Copyright. {PROSE}</p></footer><script>x</body>"""


def test_article_alone():
    want = f"Head & line First boldword {PROSE}Second one next line Third: {PROSE}".strip()
    assert hx.main_text(PAGE) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<nav><a href=x>Menu</a></nav>", ""),
        ("<html><body><div><p>" + PROSE * 3 + "</p></div></body></html>", (PROSE * 3).strip()),
        ("<article><p>" + PROSE + "<p>Short.<p>" + PROSE + "</article>", f"{PROSE}Short. {PROSE}".strip()),
        ("<article><p>a &lt;b&gt; &#233;&euro; 1 < 2 " + PROSE, f"a <b> é€ 1 < 2 {PROSE}".strip()),
        ("<ARTICLE><P CLASS='x'>" + PROSE + "</P></ARTICLE>", PROSE.strip()),
        ("<article><p>" + PROSE + "</p><ul><li>item one of the list<li>item two of the list</ul></article>", PROSE + "item one of the list item two of the list"),
    ],
)
def test_pages(page, want):
    assert hx.main_text(page) == want


@pytest.mark.parametrize("tag", ["<svg class='i'/>", '<svg viewBox="0 0 1 1" />', "<svg>", "<math/>", "<canvas id=c>", "<video src='x' />", "<object data=x>", "<template>"])
def test_tags_without_an_end_swallow_no_text(tag):
    page = f"<body><nav>{tag}<a href=x>Menu</a></nav><article><p>{PROSE}</p>{tag}<p>{PROSE}</p></article>"
    assert hx.main_text(page) == (PROSE * 2).strip()
    if tag.endswith("/>"):
        assert hx.main_text(f"{page}<footer>{tag}<svg><title>No</title><text>no</text></svg></footer>") == (PROSE * 2).strip()


def test_hidden_elements_and_formulas():
    page = f"<article><p>{PROSE}<svg><title>No</title><path d='M0 0'/><text>no</text></svg>Here <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>x=1</annotation></math> holds.</p><video><p>no</p></VIDEO ><script>var a = '<svg/>'</article>"
    assert hx.main_text(page) == f"{PROSE}Here x=1 holds."
    assert hx.main_text("<article><p>" + PROSE + "<svg>" * 50_000) == PROSE.strip()


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>" + PROSE * 4 + "</p>"
    assert hx.main_text(deep) == (PROSE * 4).strip()
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    assert len(hx.main_text(long)) == 20_000 * len(PROSE) - 1
    assert hx.main_text("<" * 100_000) is not None and hx.main_text("<p " * 20_000) is not None


def test_rows(spark, sf):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 2), (1, "u", PAGE, 3)], "page_id long, url string, html string, text int")
    got = hx.extract(df).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got) and [r["n_chars"] for r in got if r["page_id"] is None] == [0]
    assert hx.extract(df.limit(0)).collect() == []
    assert hx.op3_html_extraction(spark, sf).where("n_chars > 0").count() == spark.read.parquet(f"{sf}/pages.parquet").where("html IS NOT NULL").count()


LINKS = "<div><a href=/>Home</a></div><div><a href=/b>About us</a></div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article class='post-share'><p>{PROSE}</p></article>", PROSE),
        (f"<article><h2 class='section-header'>Part one</h2><p>{PROSE}</p></article>", f"Part one {PROSE}"),
        (f"<div><h1>News</h1><p>{PROSE * 3}</p></div>", f"News {PROSE * 3}"),
        (f"{LINKS}<div><h1>News</h1><p>{PROSE}</p><p>Short one</p><p>{PROSE}</p></div>{LINKS}", f"News {PROSE}Short one {PROSE}"),
        (f"<article><p>Ok</p></article><footer><p>{PROSE * 9}</p><p>{PROSE * 9}</p></footer>", "Ok"),
        (f"<article><p>{PROSE}</p></article><ol class=comments><li><article class=comment><p>{PROSE * 9}</p></article></ol>", PROSE),
        (f"<form id=all><div>{LINKS}</div><div><p>{PROSE * 3}</p></div></form>", PROSE * 3),
        (f"<main><header><h1>Title</h1></header><p>{PROSE}</p><aside>{PROSE}</aside><p>End</p></main><header>{PROSE}</header>", f"Title {PROSE}End"),
        ("<article><p>a​b\x00c   d</p></article>", "a​b\x00c d"),
        (f"<article><p title='a > b'>{PROSE}</p><p data-x=\"<p>no</p>\" class=x>{PROSE}</p></article>", PROSE * 2),
        (f"<article><p>{PROSE}<a href='x>y</a></p><p>{PROSE}</p></article>", f"{PROSE}y {PROSE}"),
    ],
)
def test_names_and_neighbours(page, want):
    assert " ".join(hx.main_text(page).split(" ")) == want.strip()


def small_page(rng):
    """Nested elements, with or without a meaning, around texts of all kinds."""
    inner = lambda depth: "".join(
        f"<{tag}{rng.choice(['', '', ' class=ad', ' class=content', ' class=more'])}>{inner(depth + 1) if depth < 3 and rng.random() < 0.6 else rng.choice(['Short', 'Ok.', PROSE, '<a href=x>Link text</a>', PROSE * 3])}</{tag}>"
        for tag in rng.choices(["div", "p", "section", "nav", "article", "h2", "ul", "footer"], k=rng.randint(1, 3))
    )
    return inner(0)


def test_labels_have_the_least_cost_on_small_pages():
    rng = random.Random(6)
    tried = changed = 0
    while tried < 150:
        blocks, elements = hx.parsed(page := small_page(rng))
        unary, edges = hx.graph(blocks, elements)
        if not 1 <= len(unary) <= 12:
            continue
        tried += 1
        every = {x: cost(x, unary, edges) for x in itertools.product((False, True), repeat=len(unary))}
        best = min(every.values())
        # Texts of all labellings of least cost: ties may go either way.
        texts = {" ".join(b.text for b, keep in zip(blocks, x, strict=False) if keep) for x, c in every.items() if c < best + 1e-9}
        assert hx.main_text(page) in texts
        changed += all((u > 0) != hx.min_cut(unary, edges)[k] for k, u in enumerate(unary[:1]))
    assert changed > 10


def test_the_cut_decides(spark, sf, monkeypatch):
    """Neighbours change labels on the tables' pages, and pages without telling elements reach the maximum flow."""
    changed = n = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").where("html IS NOT NULL").collect():
        blocks, elements = hx.parsed(r["html"])
        unary, edges = hx.graph(blocks, elements)
        changed += sum((u > 0) != keep for u, keep in zip(unary[: len(blocks)], hx.min_cut(unary, edges), strict=False))
        n += len(blocks)
    assert n / 20 < changed < n / 2
    flows = []
    real = hx.max_flow
    monkeypatch.setattr(hx, "max_flow", lambda theta, edges: flows.append(len(theta)) or real(theta, edges))
    page = "<div>" + "".join(f"<div><h3>Head {k}</h3><p>{PROSE}</p><p>Few words</p></div>{LINKS}" for k in range(50)) + "</div>"
    text = hx.main_text(page)
    assert flows and max(flows) > 50 and text.count(PROSE.strip()) == 50 and text.count("Few words") == 50 and "About us" not in text


@pytest.mark.parametrize("piece", ["<a b='", "<p ", "<a b='x'", "<!--", "<!", "</script ", "<script>x", "<svg>", "<b>", "</i>", "<div>", "<p>x", "<li>x", "<div><p>x y.</p>", "&", "<a href=\"x>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.perf_counter()
    hx.main_text("<article><p>" + PROSE + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 20


def test_query_on_the_table(spark, sf):
    """The tables' pages have one article and no boilerplate in it: its blocks by a parser of this test's own."""
    ends = {"p", "h1", "h2", "h3", "li", "ul", "ol", "div", "br", "article", "blockquote", "table", "tr", "td", "section"}

    class Blocks(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.skip, self.parts = 0, 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.skip += tag in ("script", "style")
            if tag in ends:
                self.parts.append("")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.skip -= tag in ("script", "style")
            if tag in ends:
                self.parts.append("")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.parts[-1] += data

    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in hx.op3_html_extraction(spark, sf).collect()}
    assert len(rows) == len(got) > 0
    for r in rows:
        own = Blocks()
        own.feed(r["html"] or "")
        own.close()
        assert got[r["page_id"]] == " ".join(t for p in own.parts if (t := " ".join(p.split()))), r["page_id"]
