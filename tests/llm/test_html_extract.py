"""Main-text extraction: hand-made pages of several kinds, and the tables' pages against their own templates."""

import html
import random
import re

import pytest

from palisade.llm.html_extract import LABELLED_PAGES, best_region, default_weights, extract, extract_pages
from tests.llm.conftest import SF

CASES = {
    "article with everything around it": (
        '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>'
        '<div class="ad">Buy now and save a lot of money today</div><article><h1>Title  of\nit</h1><p>First &amp; best &lt;text&gt;, with <b>bold</b> words.</p><p>Second paragraph stands here.</p></article>'
        "<aside>Most read this week by all our readers</aside><footer>&copy; all rights reserved by us</footer></body></html>",
        "Title of it\nFirst & best <text>, with bold words.\nSecond paragraph stands here.",
    ),
    "no article element": (
        '<body><div id="cookie-banner">We use cookies, please accept them</div><div class="content"><p>The body of the page has a few good sentences in it.</p><p>And one more sentence to end with.</p></div>'
        '<div class="comments"><p>Nice one, I liked it very much indeed</p></div><form><label>Name</label></form></body>',
        "The body of the page has a few good sentences in it.\nAnd one more sentence to end with.",
    ),
    "advert inside the article": ("<article><p>Before the advert come words.</p><div class='advert'>Cheap lamps for all</div><p>After the advert come words.</p></article>", "Before the advert come words.\nAfter the advert come words."),
    "unclosed tags": ("<article><p><b>One open paragraph of words<p>Next paragraph of words</article><footer>foot", "One open paragraph of words\nNext paragraph of words"),
    "comment with markup": ("<article><!-- <p>hidden words</p> --><p>Seen words only, please.</p></article>", "Seen words only, please."),
    "nothing": ("<nav><a href='/'>Home</a></nav>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert extract(page, default_weights()) == want


def test_labelled_pages_give_back_their_labels():
    for page in LABELLED_PAGES:
        marked = page[page.index("<!--main-->") : page.index("<!--end-->")]
        words = html.unescape(re.sub(r"<[^>]*>", " ", marked)).split()
        assert extract(page.replace("<!--main-->", "").replace("<!--end-->", ""), default_weights()).split() == words


def test_scan_finds_the_best_region_of_all():
    """The linear scan against all regions."""
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice((-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0)) for _ in range(rng.randint(0, 14))]
        first, last = best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)
        assert sum(scores[first : last + 1]) == max(best, 0.0)


STORY = "<h1>Ferry returns</h1><p>The ferry came back to the island on Friday after a long winter in the yard, and the pier was full.</p><p>Short one.</p>"
TEXT = "Ferry returns\nThe ferry came back to the island on Friday after a long winter in the yard, and the pier was full.\nShort one."
UNMARKED = {
    "menu and teasers without a mark": f'<body><div><a href="/">Home</a> <a href="/n">News of the day and more</a></div><div>{STORY}</div><div><a href="/x">Ten islands to see before the summer ends</a><br><a href="/y">What the captain says of it all</a></div></body>',
    "loose words around a main element": f"<body><p>Welcome to the site of the old town, dear readers</p><main>{STORY}</main><p>Thank you for reading this site to its very end</p></body>",
    "a link list between two parts": f"<body><div>{STORY}</div><div><a href='/1'>one more link</a> <a href='/2'>and one more link again</a></div><p>The captain told us that she had missed the smell of the sea more than anything.</p></body>",
}


@pytest.mark.parametrize("name", UNMARKED)
def test_weights_decide_where_nothing_is_marked(name):
    """With every weight the same the scan takes the whole page; the learned ones find the text."""
    page = UNMARKED[name]
    got = extract(page, default_weights())
    assert TEXT in got and not re.search("Home|Ten islands|Welcome|Thank you|one more link", got)
    flat = extract(page, {"bias": 1.0})
    assert flat != got and len(flat) > len(got)


KEPT = {
    "a price within the article": ("<article><p>Some words of text</p><div class='share-price'>The share stood at ten when the market closed today</div><p>More text</p></article>", "Some words of text\nThe share stood at ten when the market closed today\nMore text"),
    "a subject that sounds like a part of the page": (f"<article><div class='foot-care'>{STORY}</div></article>", TEXT),
    "a page in one form": (f"<body><form action='/x'><div class='menu'><a href='/'>Home</a></div><div>{STORY}</div></form></body>", TEXT),
    "a wrapper named after its sidebar": (f"<body><div class='sidebar'><main>{STORY}</main></div></body>", TEXT),
    "links of the article": ("<article><p>Words that lead to the links below</p><ul><li><a href='/a'>First source</a></li><li><a href='/b'>Second</a></li></ul></article>", "Words that lead to the links below\nFirst source\nSecond"),
} | {f"an unclosed {name}": (f"<article><p>Before it</p><{name} width=3>{STORY}</article>", f"Before it\n{TEXT}") for name in ("svg", "noscript", "canvas", "iframe", "object", "template")}


@pytest.mark.parametrize("name", KEPT)
def test_text_of_the_article_stays(name):
    page, want = KEPT[name]
    assert extract(page, default_weights()) == want


@pytest.mark.parametrize("mark", ["class=ad", "class='ad-banner'", "id=cookie_notice", "class='site comments-area'", "class=newsletterSignup", "role=search", "hidden", "style='display: none'", "class='social-share bottom'"])
def test_boilerplate_within_the_article_goes(mark):
    assert extract(f"<article>{STORY}<div {mark}>Words of no use to any reader of this</div><p>And the end of it.</p></article>", default_weights()) == f"{TEXT}\nAnd the end of it."


def test_long_and_hostile_pages_end():
    for page in ("<" * 200_000, "<a href='" * 20_000, "<div>" * 50_000, "<p " + "a=b " * 50_000, "<!--" * 50_000, "&amp" * 50_000):
        extract(page, default_weights())


def test_tables_pages(spark):
    """In these pages the article element holds the text; blocks are parted by headings, paragraphs and breaks don't part."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:h1|h2|p|div|ul|li)\b[^>]*>", inner)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
        text = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (text, len(text))


def test_table_edges(spark):
    rows = [(1, "u", "<p>Some words on a page of text.</p>"), (1, "u", "<p>Some words on a page of text.</p>"), (None, None, None), (2, None, "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'y' AS n_chars")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract_pages(frame).collect()))
    assert got == [(0, "", 0), (1, "Some words on a page of text.", 29), (1, "Some words on a page of text.", 29), (2, "", 0)]
    assert extract_pages(frame.limit(0)).count() == 0
