"""HTML extraction: the tree, the matching, and whole pages."""

from __future__ import annotations

import html as references
import random
import re

import pytest

from metricweave.llm.catalog import LLM_QUERIES
from metricweave.llm.dom import blocks, parse
from metricweave.llm.wrappers import (
    GOES, MAY_GO, align, article_blocks, extract_articles, match, merge, read_tree, skeleton, write_tree,
)


def text_of(html: str) -> str:
    """The article of a page whose site has no other."""
    return "\n".join(t for _, t, m in article_blocks(parse(html))[0] if not m & (MAY_GO | GOES))


@pytest.mark.parametrize("html, expected", [
    ("", []),
    ("plain  text\n here", ["plain text here"]),
    ("<p>a<p>b &amp;amp; &lt;c&gt;<br>d", ["a", "b &amp; <c> d"]),
    ("<div>x<p>y</div>z", ["x", "y", "z"]),
    ("<p>a<b>b<i>c</b>d</i>e</p>f", ["abcde", "f"]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["1", "2", "3", "4"]),
    ("<script>if (a<b) '</p>'</script>k<style>p{}</style><!-- <p>no</p> -->m<!-- open", ["km"]),
    ("<p title=\"a>b\" class='x'>q</p><p title=\"open>r</p>", ["q", "r"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<p>cut in the midd", ["cut in the midd"]),
    ("</p></div><p>x</p></article></html>tail", ["x", "tail"]),
    ("<p>a" + "<b>" * 3000 + "x" + "<div>" * 3000 + "y", ["ax", "y"]),
])
def test_blocks(html, expected):
    assert [t for _, t, _ in blocks(parse(html))] == expected


def test_parts_beside_the_article_go():
    page = """<html><head><title>T</title></head><body class="with-sidebar"><div id="cookie-notice">We use cookies.</div>
    <header class="site-header"><a href="/">Home</a></header><nav>Menu</nav>
    <div class="wrapper"><div class="post-content"><header><h1>Title &amp; more</h1></header><p>First
    paragraph.</p><div class="ad-slot">Buy</div><ul><li>one</li></ul><form><label>Mail</label></form>
    <section id="comments"><article class="comment"><p>Nice!</p></article></section></div>
    <div class="sidebar"><p>Popular posts and much other text that is rather long, longer than the article itself</p></div></div>
    <footer>Imprint</footer></body></html>"""
    assert text_of(page) == "Title & more\nFirst paragraph.\none"


def test_page_without_a_named_article():
    page = "<body><div id=menu><a>x</a></div><div><p>Some text with a <a>link</a>.</p><p><a>all of it a link</a></p></div></body>"
    assert text_of(page) == "Some text with a link."


@pytest.mark.parametrize("page, expected", [
    ("<div class=post><h1>Title</h1><div class=post-body><p>Long text of the post.</p></div></div>", "Title\nLong text of the post."),
    ("<div class=content><div class=text>A</div><div class=text>B, longer</div></div>", "A\nB, longer"),
    ("<div><div class=text>A</div><p>x</p><div class=text>B, longer</div></div>", "A\nB, longer"),
    ("<main><article><p>Part one, longer</p></article><article><p>Part two</p></article></main>", "Part one, longer\nPart two"),
    ("<div><div><article><p>One</p></article></div><div><article><p>Two, longer</p></article></div></div>", "One\nTwo, longer"),
    ("<article><h1>Title</h1><article><p>Inner text, longer</p></article></article>", "Title\nInner text, longer"),
    ("<main><h1>Title</h1><p>x</p><article><p>Text</p></article></main>", "Title\nText"),
    ("<div class=post><h1>Title</h1><article><p>Text</p></article></div>", "Title\nText"),
    ("<article><p>Story, the longer one</p></article><div><article class=card><p>Teaser</p></article></div>", "Story, the longer one"),
    ("<p>See <a>this rather long title of a linked page</a>.</p><p><a>all of it a link</a></p>", "See this rather long title of a linked page."),
    ("<div class=post><div class=sidebar>Other</div><h1>Title</h1><nav>Menu</nav><p>Text</p></div>", "Title\nText"),
])
def test_all_parts_of_the_article_stay(page, expected):
    assert text_of(page) == expected


LONG = "<p>A paragraph of the article that is long enough to be one.</p>"
TOLD = "A paragraph of the article that is long enough to be one."


@pytest.mark.parametrize("page, expected", [
    # a main with the article's text, and one other article announced in it
    (f"<main><h1>Title</h1>{LONG}{LONG}<article><h3><a href=x>Other</a></h3><p>Teaser</p></article></main>", ["Title", TOLD, TOLD]),
    (f"<main><h1>Title</h1>{LONG}{LONG}<article class=teaser><p>Teaser</p></article></main>", ["Title", TOLD, TOLD]),
    # other articles in a part beside
    (f"<article><h1>T</h1>{LONG}</article><section class=related><article><h2>Other</h2>{LONG}{LONG}</article></section>", ["T", TOLD]),
    (f"<article><h1>T</h1>{LONG}</article><div class=sidebar><article>{LONG}{LONG}</article></div>", ["T", TOLD]),
    (f"<main><article><h1>T</h1>{LONG}</article><section class=related><article>{LONG}{LONG}</article></section></main>", ["T", TOLD]),
    (f"<div class='page has-sidebar'><article><h1>T</h1>{LONG}</article><div class=sidebar><article>{LONG}{LONG}</article></div></div>", ["T", TOLD]),
    # comments, one in the other, longer than the article
    (f"<article><h1>T</h1><p>Short.</p></article><article class=comment>{LONG}<article class=comment>{LONG}</article></article>", ["T", "Short."]),
    (f"<article><h1>T</h1><p>Short.</p><article class=comment>{LONG}<article class=comment>{LONG}</article></article></article>", ["T", "Short."]),
    # names inside an article that say nothing against a part
    *[(f"<article><h1>T</h1>{LONG}<{tag} {name}>{LONG}</{tag}></article>", ["T", TOLD, TOLD]) for tag, name in (
        ("div", "class=form"), ("div", "class=text-share"), ("p", "class=alert"), ("section", "class=skip"),
        ("section", "class=related-work"), ("section", "id=discussion"))],
    (f"<article class=alert>{LONG}</article>", [TOLD]),
    # those that do
    (f"<article><h1>T</h1>{LONG}<div class=share><a>Mail</a> <a>Print</a></div><div class=related-posts><ul><li><a>Other post</a></ul></div>"
     f"<div class='ad-box'>Buy</div><form><p>Name</p></form><div class=newsletter>Sign up</div><div class=notice>Terms</div></article>", ["T", TOLD]),
])
def test_measured_layouts(page, expected):
    assert text_of(page) == "\n".join(expected)


def test_template_decides_what_names_leave_open(spark):
    """Parts named for notices stay where their text varies and go where it does not; a constant heading stays."""
    page = (
        "<body><article><h1>Title {0}</h1><h2>Summary</h2><p>In short {0}.</p><p>All of it {0}.</p>"
        "<div class=notice>Note {0} of the author.</div><div class=related-note>Read our terms.</div><h2>About us</h2><p>We write.</p></article></body>"
    )
    rows = [(i, "http://a.example/", page.format(i)) for i in range(9)] + [(100, "http://b.example/", page.format(100))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in extract_articles(df, keep_html=False).collect()}
    told = "Title {0}\nSummary\nIn short {0}.\nAll of it {0}."
    assert got == {i: told.format(i) + f"\nNote {i} of the author." for i in range(9)} | {
        # one page alone: the lists decide, and nothing is constant
        100: told.format(100) + "\nRead our terms.\nAbout us\nWe write.",
    }


def test_deep_and_long_pages(spark):
    """A page of very deep elements, alone and among others of its host, costs no other page its text."""
    deep = "<body>" + "<div class=share>" * 10_000 + "<p>Deep text</p>" + "</div>" * 10_000
    long = "<article>" + "".join(f"<p>Paragraph {i}.</p>" for i in range(30_000)) + "</article>"
    rows = [(i, "http://a.example/", deep.replace("text", f"text {i}")) for i in range(6)]
    rows += [(10, "http://a.example/", "<article><p>Plain</p></article>"), (11, "http://b.example/", long)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(2)
    got = {r["page_id"]: r["text"] for r in extract_articles(df, keep_html=False).collect()}
    assert got[10] == "Plain" and got[11] == "\n".join(f"Paragraph {i}." for i in range(30_000)) and len(got) == 8
    assert {got[i] for i in range(6)} <= {"", *(f"Deep text {i}" for i in range(6))}


def test_trees_as_text():
    for html in ("", "<p>a", "<div><p>a</p><ul><li>1</ul></div><div class=x3>b</div>", "<div>" * 5000):
        t = tree(html)
        assert write_tree(read_tree(write_tree(t))) == write_tree(t)
    deep = tree("<div>" * 5000)
    assert match(deep, tree("<div>" * 5000))[0] == size(deep) and size(merge(deep, deep)) == size(deep)


def tree(html: str):
    return skeleton(parse(html))


def size(t) -> int:
    return write_tree(t).count("[") - 1


def plain_match(a, b) -> int:
    """The recurrence of simple tree matching, written out."""
    if a[0] != b[0]:
        return 0
    def over(x, y):
        if not x or not y:
            return 0
        return max(over(x[:-1], y), over(x, y[:-1]), over(x[:-1], y[:-1]) + plain_match(x[-1], y[-1]))
    return over(a[2], b[2]) + 1


def test_matching_and_merging():
    rng = random.Random(4)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "ul", "section"], k=rng.randint(0, 3)))

    for _ in range(40):
        a, b = tree(some(2)), tree(some(2))
        pairs = match(a, b)[0]
        assert pairs == plain_match(a, b) and match(a, a)[0] == size(a)
        both = merge(a, b)
        assert size(both) == size(a) + size(b) - pairs
        assert len(align(both, a)) == size(a)


def test_constant_texts_of_a_host_go(spark):
    page = "<body><article><h1>Title {0}</h1><p>Read our terms before you go on.</p><p>Text {0} of page.</p></article></body>"
    rows = [(i, "http://A.example/x", page.format(i)) for i in range(9)]
    rows += [(100, "http://b.example/", page.format(100)), (101, None, None), (102, "nothing", ""), (103, "http://c.example", "x")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in extract_articles(df).collect()}
    assert got == {i: f"Title {i}\nText {i} of page." for i in range(9)} | {
        100: "Title 100\nRead our terms before you go on.\nText 100 of page.", 101: "", 102: "", 103: "x",
    }


def test_same_pages_keep_their_text(spark):
    rows = [(1, "http://a.example/x", "<article><p>Same</p></article>", "t")] * 12
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string").repartition(3)
    out = extract_articles(df)
    assert out.columns == ["page_id", "url", "html", "text"] and {r["text"] for r in out.collect()} == {"Same"} and out.count() == 12
    assert extract_articles(df.limit(0)).isEmpty()


def near_copies(first: int, count: int, terms: str = ""):
    """Copies of one article that differ in one paragraph."""
    shared = [f"Paragraph {k} that all copies share." for k in range(6)]
    for i in range(first, first + count):
        parts = ["Title of the copies", *shared[:3], f"Only in copy {i}.", *shared[3:]]
        yield i, parts, "<article>" + "".join(f"<p>{p}</p>" for p in [*parts, *([terms] if terms else [])]) + "</article>"


def test_near_copies_keep_their_text(spark):
    terms = "Read our terms."
    pages = [(i, "http://a.example/", parts, html) for i, parts, html in near_copies(0, 7)]
    pages += [(i, "http://b.example/", parts, html) for i, parts, html in near_copies(100, 30, terms)]
    for host, ids, end in (("a", range(7, 9), ""), ("b", range(130, 136), f"<p>{terms}</p>")):
        for i in ids:
            parts = [f"Title {i}", f"First text {i}.", f"Second text {i}."]
            pages.append((i, f"http://{host}.example/", parts, "<article>" + "".join(f"<p>{p}</p>" for p in parts) + end + "</article>"))
    df = spark.createDataFrame([(i, url, html) for i, url, _, html in pages], "page_id int, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in extract_articles(df).collect()}
    assert got == {i: "\n".join(parts) for i, _, parts, _ in pages}


def test_query_on_all_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = LLM_QUERIES["op1_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[row["page_id"]], re.S)[1]
        cut = re.split(r"</?p>|</?h1>", inner.replace("<br>", " "))
        plain = [" ".join(references.unescape(re.sub("<[^>]*>", "", part)).split()) for part in cut]
        assert row["text"] == "\n".join(p for p in plain if p) and row["n_chars"] == len(row["text"])
