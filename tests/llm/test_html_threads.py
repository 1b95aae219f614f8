"""What stands in an article stays whatever its class names as a subject; threads of comments go without a mark; the scan decides on pages without marks."""

import html
import re

import pytest

from palisade.llm.html_extract import BLOCKS, default_weights, extract
from tests.llm.conftest import SF

BEFORE = "<h1>Ferry returns</h1><p>The ferry came back to the island on Friday after a long winter in the yard, and the pier was full.</p>"
AFTER = "<p>And the captain told us that she had missed the smell of the sea.</p>"
TEXT = "Ferry returns\nThe ferry came back to the island on Friday after a long winter in the yard, and the pier was full."
END = "And the captain told us that she had missed the smell of the sea."

SUBJECTS = {
    '<section class="discussion"><h2>Discussion</h2><p>Our figures agree with those of the earlier study.</p></section>': "Discussion\nOur figures agree with those of the earlier study.",
    '<div id="legal"><p>The court held that the contract was void from the start.</p></div>': "The court held that the contract was void from the start.",
    '<div id="right-side"><p>On the right side of the valley stand the old barns.</p></div>': "On the right side of the valley stand the old barns.",
    "<menu><li>Five hundred grams of flour</li><li>Two eggs</li></menu>": "Five hundred grams of flour\nTwo eggs",
    '<div class="search"><p>The search for the lost boat took nine days.</p></div>': "The search for the lost boat took nine days.",
    '<div class="notice"><p>A notice on the door said that the shop was closed.</p></div>': "A notice on the door said that the shop was closed.",
    "<h2>Comments on the plan</h2><p>The council had no objection.</p>": None,
}


@pytest.mark.parametrize("inner", SUBJECTS)
@pytest.mark.parametrize("root", ["article", "main"])
def test_subjects_stay(inner, root):
    want = SUBJECTS[inner]
    if want is not None:
        assert extract(f"<body><{root}>{BEFORE}{inner}{AFTER}</{root}></body>", default_weights()) == f"{TEXT}\n{want}\n{END}"


THREAD = "<div><b>Ann</b> says: <p>What a lovely old ship she is, and how well they have painted her.</p></div><div><b>Bob</b> says: <p>I was there and it rained on all of us.</p></div>"


@pytest.mark.parametrize("head", ["<h3>5 responses</h3>", "<h2>Comments (12)</h2>", "<h4>3 Kommentare zu diesem Text</h4>", "<h3>2 r&eacute;ponses</h3>", "<h3>Leave a reply</h3>", "<h3>Reader comments:</h3>", "<h3>12 comentarios</h3>"])
def test_threads_of_comments_go(head):
    inside = f"<body><article>{BEFORE}{AFTER}<section>{head}{THREAD}</section></article></body>"
    behind = f"<body><article>{BEFORE}{AFTER}</article><div>{head}{THREAD}</div></body>"
    last = f"<body><article>{BEFORE}{AFTER}{head}{THREAD}</article></body>"
    for page in (inside, behind, last):
        assert extract(page, default_weights()) == f"{TEXT}\n{END}"


def test_a_thread_ends_with_its_element():
    page = f"<body><article><div>{BEFORE}<section><h3>2 comments</h3>{THREAD}</section></div>{AFTER}</article></body>"
    assert extract(page, default_weights()) == f"{TEXT}\n{END}"


def test_headings_that_only_begin_so_stay():
    for head in ("Responses of plants to light", "Commenting on the weather", "Comment la mer monte"):
        assert head in extract(f"<body><article>{BEFORE}<h2>{head}</h2>{AFTER}</article></body>", default_weights())


def test_scan_decides_on_pages_without_marks(spark):
    """The tables' pages with all elements of a region made plain and all marks taken away: what is left to go by are words, links and
    lengths. The region and its gaps must leave out what all blocks together don't."""
    everything = {k: 0.0 for k in default_weights()} | {"bias": 1.0, **{f"tag:{t}": 0.0 for t in BLOCKS}, "tag:inline": 0.0, "tag:br": 0.0}
    kept = {"learned": [0, 0, 0], "flat": [0, 0, 0]}
    differ = 0
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.DOTALL)[1]
        want = set(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        page = re.sub(r"<(/?)(?:article|nav|aside|footer|header|main|form|section|label|button)\b[^>]*>", r"<\1div>", r.html)
        page = re.sub(r"<(div|ul|p|span)\s[^>]*>", r"<\1>", page)
        got = {"learned": extract(page, default_weights()), "flat": extract(page, everything)}
        differ += got["learned"] != got["flat"]
        for name, text in got.items():
            words = set(text.split())
            for i, n in enumerate((len(words & want), len(words), len(want))):
                kept[name][i] += n
    f1 = {name: 2 * both / (found + wanted) for name, (both, found, wanted) in kept.items()}
    assert differ > 0.5 * len(rows) and f1["learned"] > f1["flat"], f1
    assert kept["learned"][0] > 0.9 * kept["learned"][2]
