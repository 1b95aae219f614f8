"""Main-text extraction by a maximum-scoring subsequence over a page's words and tags.

A page is cut into words and tags. A word has features: whether it stands in the page's content root, in a link, in
a short block, in an element whose class or id hints at boilerplate, in a heading, item or cell. Each feature has a
weight, the log-odds in labelled pages of standing inside the main text, and a word's score is their sum (naive Bayes);
tags score negative. A linear scan finds the contiguous region with the largest sum. Inside the region, a block whose
own words add up to less than zero is a gap and is left out, and so is what stands in an element that is boilerplate by
its name or role (menus, footers, sidebars, forms, scripts) or by a class or id that says nothing else ("ad-banner", but
not "share-price", which is only a hint); inside an article or main element, words that can name a subject as well
("discussion", "legal") are hints too, and a menu is a list. A heading such as "5 responses" begins a thread of comments that
reaches to the end of its element. Such blocks weigh nothing in the scan, so an advert doesn't split an article. A
form that holds over half of the words, and a marked element around a main element or heading, is the page itself.

The labelled pages are LABELLED_PAGES (their main text stands between <!--main--> and <!--end-->); pass others to
`fit` for another kind of site. Pages are independent, so a hot host costs nothing extra.

Defined results: a null, empty or text-free page has the empty text; repeated rows each get a row; broken markup is
read as browsers do (an unfinished tag at the end is dropped, unclosed elements reach to the end), but a skipped
element that is never closed, other than a script or style, hides nothing; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import map_batches

# Elements and the words in class, id and role that mark boilerplate.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title textarea select audio video noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NESTING = frozenset("article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section table td th tr ul button label a span p li h1 h2 h3 h4 h5 h6 blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button label fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus discussion reply replies respond share sharing social follow related recommended popular trending newsletter subscribe signup login search widget pagination pager copyright legal skip".split()
)
CONTENT_ROOTS = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<(?P<loose>/?[a-zA-Z])[^>]*+(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=/>]|\Z)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
ANY_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Words of BOILER_WORDS that name subjects and places as well; inside an article or main element they are hints alone, and a menu is a list.
WEAK_WORDS = frozenset("alert banner copyright discussion follow foot header legal masthead menu notice overlay popular rail recommended reply replies respond search share side skip submenu toolbar trending widget".split())
#: What the heading of a thread of readers' comments says, with or without their number.
THREAD_WORDS = (
    "comments comment responses response replies reply commentaires commentaire réponses réponse kommentare kommentar antworten antwort comentarios comentario respuestas respuesta".split()
)
THREAD = re.compile(rf"(?:\d[\d.,]*|reader|readers'|user|your|all)?\s*(?:{'|'.join(THREAD_WORDS)})(?:\s+(?:to|on|sur|zu|a|en|für)\s.*)?\s*(?:\(\d+\))?:?|leave a (?:reply|comment)|\d+ thoughts on .*", re.IGNORECASE | re.DOTALL)
#: Words in class and id that say nothing of what an element is.
STRUCTURE_WORDS = frozenset("area block body bottom box bar btn button container content div global group inner item items left links link list main mobile module outer page panel primary right row secondary section site text top unit wrap wrapper zone".split())
#: Elements that may turn out to hold the page itself, and skipped ones that reach to the end where they are not closed.
RAW = frozenset(("script", "style"))
PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def boiler_mark(name: str, attrs: str, rooted: bool = False) -> str:
    """What an element's name, role, class and id say of boilerplate: `tag`, `name` (by class or id alone), `hint` or nothing.
    rooted: it stands in an article or main element."""
    if name in BOILER_TAGS and not (rooted and name == "menu"):
        return "tag"
    if not attrs or name in CONTENT_ROOTS or name in ("body", "html"):
        return ""
    found = ""
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "tag"
        if key == "role" and value.lower() in BOILER_ROLES:
            return "tag"
        if key in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in PARTS.findall(one)]
                if any(p in BOILER_WORDS for p in parts) and parts[0] not in ("has", "with", "no"):
                    told = any(p in BOILER_WORDS and not (rooted and p in WEAK_WORDS) for p in parts)
                    if told and all(p in BOILER_WORDS or p in STRUCTURE_WORDS or p.isdigit() for p in parts):
                        return "name"
                    found = "hint"
    return found


def is_main(name: str, attrs: str) -> bool:
    """Whether an element is the page's main one, by name or role (in any case and quoting)."""
    if name == "main" or "main" not in (low := attrs.lower()) or "role" not in low:
        return name == "main"
    return any(k == "role" and "main" in v.strip("\"'").split() for k, v in ANY_ATTRIBUTE.findall(low))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): kind is text, open, close or mark (a labelled page's comment)."""
    at, end, skip = 0, len(page), None
    while at < end:
        if skip:  # raw text to the closing tag
            m = re.compile(rf"</{skip}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if skip == "head":  # a head that is never closed ends where the body or its contents begin
                m = re.compile(r"</head\s*>|(?=<(?:body|article|main|div|p|nav|header|h1)[\s>])", re.IGNORECASE).search(page, at)
            if not m and skip in RAW:
                return
            at, skip = m.end() if m else at, None  # never closed: nothing is skipped
            continue
        m = TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m["name"]:
            name = m["name"].lower()
            if not m["close"] and name in SKIPPED:
                skip = None if m["attrs"].endswith("/") and name in ("svg", "math") else name
                continue
            yield ("close" if m["close"] else "open"), name, m["attrs"]
        elif m["comment"] is not None and m["comment"] in ("main", "end"):
            yield "mark", m["comment"], ""


def pieces(page: str) -> tuple[list[tuple[tuple[str, ...], str, int]], list[bool]]:
    """The page as (features, text, block) and, by block, whether it stands in boilerplate.

    Features are (`tag:NAME`,) for a tag, (`mark`,) for a label and several for a run of text. Whether the page has content
    roots is read from its elements outside boilerplate: a main element that holds words is one, and so are articles if
    the largest holds at least half as many running words as stand outside all roots (teaser cards do not)."""
    stack: list[tuple[str, int, bool, bool, bool]] = []  # name, number of the marked element or -1, main, article, hint
    marked: list[list] = []  # by number: may be the page itself, words in it, holds a main element or heading
    inside: tuple[int, ...] = ()  # numbers of the marked elements that are open
    mains = articles = links = hints = n_articles = 0
    out: list[tuple[tuple[str, ...], str, int]] = []
    blocks: list[tuple[tuple[int, ...], bool, int, str]] = []  # by block: marked elements, in main, number of the article or 0, kind
    texts: list[tuple[int, int, bool, bool]] = []  # place in out, words, in a link, in an element with a hint
    sizes: list[int] = []
    running: list[int] = []  # by block: words that stand in no link
    threads: list[int] = []  # depths of the elements in which a thread of comments has begun; each reaches to its element's end
    heading = 0  # where the open heading begins in out

    def fresh(kind: str) -> None:
        blocks.append((inside, bool(mains), n_articles if articles else 0, kind))
        sizes.append(0)
        running.append(0)

    def pop() -> str:
        nonlocal inside, mains, articles, links, hints
        if threads and threads[-1] == len(stack):
            threads.pop()
            inside = inside[:-1]
        name, number, was_main, was_article, was_hint = stack.pop()
        if number >= 0:
            inside = inside[:-1]
        mains, articles, links, hints = mains - was_main, articles - was_article, links - (name == "a"), hints - was_hint
        return name

    fresh("text")
    for kind, value, attrs in tokens(page):
        if kind == "mark":
            out.append((("mark",), value, -1))
            continue
        if kind == "text":
            n = count_words(value)
            sizes[-1] += n
            running[-1] += 0 if links else n
            for number in inside:
                marked[number][1] += n
            texts.append((len(out), n, bool(links), bool(hints)))
            out.append(((), value, len(blocks) - 1))
            continue
        if kind == "open" and value not in VOID and value in NESTING:
            if value in ("p", "li", "td", "th", "tr") or (value in BLOCKS and stack and stack[-1][0] == "p"):
                # An open paragraph ends at the next block, an open item at the next item.
                closes = ("p", "b", "span", "a") if value not in ("li", "td", "th", "tr") else (value, "p", "b", "span", "a")
                while stack and stack[-1][0] in closes:
                    if pop() == value:
                        break
            main, article = is_main(value, attrs), value == "article"
            mark = "tag" if value == "header" and not mains and not articles else boiler_mark(value, attrs, bool(mains or articles))
            heading = len(out) if value in HEADINGS else heading
            if main or value == "h1":
                for number in inside:
                    marked[number][2] = True
            number = -1
            if mark in ("tag", "name"):
                number = len(marked)
                marked.append([value == "form" or mark == "name", 0, False])
                inside = (*inside, number)
            n_articles += article and not articles
            stack.append((value, number, main, article, mark == "hint"))
            mains, articles, links, hints = mains + main, articles + article, links + (value == "a"), hints + (mark == "hint")
            if value == "form":
                marked[number].append("form")
        elif kind == "close" and value in NESTING and any(x[0] == value for x in stack):
            while pop() != value:
                pass
            if value in HEADINGS and THREAD.fullmatch(" ".join(html.unescape("".join(x[1] for x in out[heading:])).split())):
                # The heading, and what follows it in the same element, is a thread of comments.
                number = len(marked)
                marked.append([True, 0, False])
                inside = (*inside, number)
                threads.append(len(stack))
                blocks[-1] = ((*blocks[-1][0], number), *blocks[-1][1:])
        if value == "br":
            out.append((("tag:br",), " ", len(blocks) - 1))
        elif value in BLOCKS:
            fresh(kind_of(value if kind == "open" else stack[-1][0] if stack else ""))
            out.append(((f"tag:{value}",), "", len(blocks) - 1))
        else:
            out.append((("tag:inline",), "", len(blocks) - 1))

    total = sum(sizes)
    boiler = [not (may and (holds or (form and 2 * words > total))) for may, words, holds, *form in marked]
    bad = [any(boiler[number] for number in numbers) for numbers, *_ in blocks]
    main_words = outside = 0
    by_article: Counter = Counter()
    for at, n, in_link, _ in texts:
        block = out[at][2]
        _, in_main, article, _ = blocks[block]
        if not bad[block]:
            main_words += n if in_main else 0
            by_article[article] += n if article and not in_link else 0
            outside += n if not article and not in_main and not in_link else 0
    del by_article[0]
    by_main, by_article_too = main_words > 0, bool(by_article) and 2 * max(by_article.values()) >= outside
    for at, _, in_link, hint in texts:
        block = out[at][2]
        _, in_main, article, kind = blocks[block]
        root = (by_main and in_main) or (by_article_too and article > 0)
        place = "root" if root else "outside" if by_main or by_article_too else "plain"
        out[at] = ((f"link:{in_link}:{place}", f"hint:{hint and not root}", f"short:{running[block] < SHORT}:{place}", *(() if in_link else (f"kind:{kind}",))), *out[at][1:])
    return out, bad


def kind_of(name: str) -> str:
    return "heading" if name in HEADINGS else "item" if name in ("li", "td", "th", "dd", "dt") else "text"


def count_words(text: str) -> int:
    return len(text.split())


def fit(labelled: list[str]) -> dict[str, float]:
    """Weights by feature from labelled pages: log-odds of main text among the words (or tags) that aren't boilerplate by
    their elements, smoothed by one; the prior's is `bias`; tags are never above -0.1."""
    inside, outside = Counter(), Counter()
    for page in labelled:
        now = outside
        found, bad = pieces(page)
        for features, text, block in found:
            if features == ("mark",):
                now = inside if text == "main" else outside
            elif not bad[block]:
                n = count_words(text) if len(features) > 1 else 1
                now.update({f: n for f in (*features, *("bias",) * (len(features) > 1))})
    odds = lambda a, b: math.log((a + 1) / (b + 1))
    bias, tags = odds(inside["bias"], outside["bias"]), odds(sum(v for k, v in inside.items() if k.startswith("tag")), sum(v for k, v in outside.items() if k.startswith("tag")))
    weights = {"bias": bias}
    for k in inside | outside:
        if k.startswith("tag"):
            weights[k] = max(-2.0, min(-0.1, (odds(inside[k], outside[k]) - tags) / 4 - 0.2))
        elif k != "bias":
            weights[k] = odds(inside[k], outside[k]) - bias
    return weights


def score(features: tuple[str, ...], text: str, weights: dict[str, float]) -> float:
    """Score of a tag, or of a run of words."""
    if len(features) == 1:
        return weights.get(features[0], -0.3)
    n = count_words(text)
    return n * max(-MOST, min(MOST, weights.get("bias", 0.0) + sum(weights.get(f, 0.0) for f in features))) if n else 0.0


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, last) of the contiguous region with the largest sum, in one pass; (0, -1) if none is above zero."""
    best = now = 0.0
    start = first = 0
    last = -1
    for i, x in enumerate(scores):
        now += x
        if now > best:
            best, first, last = now, start, i
        if now <= 0:
            now, start = 0.0, i + 1
    return first, last


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found, bad = pieces(page)
    scores = [0.0 if bad[block] else score(features, text, weights) for features, text, block in found]
    first, last = best_region(scores)
    blocks: dict[int, list[str]] = {}
    sums: dict[int, float] = {}
    for (features, text, block), x in zip(found[first : last + 1], scores[first : last + 1]):
        if not bad[block] and (len(features) > 1 or features == ("tag:br",)):
            blocks.setdefault(block, []).append(text)
            sums[block] = sums.get(block, 0.0) + (x if len(features) > 1 else 0.0)
    lines = (" ".join(html.unescape("".join(texts)).split()) for block, texts in sorted(blocks.items()) if sums[block] >= 0)
    return "\n".join(line for line in lines if line)


#: Running words of a short block; the most that a word scores either way.
SHORT, MOST = 8, 3.0
LABELLED_PAGES = [
    (
        '<html><head><title>Otters</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li>'
        '</ul></nav><div class="ad">Buy two lamps and get one free today</div><article><!--main--><h1>Otters return to the river</h1><p>'
        'After forty years the otters are back, and the <a href="/r">river trust</a> counted nine of them in spring.</p><p>Short.</p><p>'
        'Anglers are less pleased: the fish, they say, are fewer than before.</p><!--end--></article><aside>'
        'Most read this week: ten walks near the water</aside><footer>&copy; 2020 River News. All rights reserved.</footer></body></html>'
    ),
    (
        '<body><div id="cookie-notice">We use cookies to make this site better. <button>Accept</button></div><div class="header"><a href="/">Bread Blog</a><p>'
        'All about baking at home</p></div><div class="content"><!--main--><h2>Rye bread</h2><p>'
        'Mix the flour with warm water and leave it for a night in a cool place.</p><ul><li>500 g of rye flour</li><li>400 ml of water</li></ul><p>'
        'Bake for an hour. Let it rest until the next day before you cut it.</p><!--end--></div><div class="comments"><p>'
        'Great recipe, thank you, mine came out well.</p><p>What if I only have wheat flour?</p></div><div class="sidebar"><h3>Archive</h3><ul><li>'
        '<a href="/1">January</a></li><li><a href="/2">February</a></li></ul></div><form action="/s"><label>Your address</label><input name="q"></form></body>'
    ),
    (
        '<body><header><h1>City Gazette</h1><p>News since 1890</p></header><main><!--main--><h1>New bridge opens</h1><p>'
        'The bridge over the canal opened on Monday after three years of work and two of delay.</p><blockquote>'
        'It was worth the wait, said the mayor.</blockquote><p>Trams will cross it from June.</p><!--end--></main><section class="related"><h2>Related</h2><p>'
        '<a href="/x">Old bridge to close</a></p><p><a href="/y">Tram lines grow again</a></p></section><footer><p>Contact the editors. Terms of use.</p>'
        '</footer></body>'
    ),
    (
        '<body><table><tr><td><a href="/1">Start</a></td><td><a href="/2">Links</a></td></tr></table><!--main--><p>'
        'My telescope is an old one with a mirror of twenty centimetres. On clear nights it shows the rings of Saturn.</p><p>'
        'Last week I saw four moons of Jupiter in a row.<br>It was cold, but I stayed until two.</p><!--end--><p class="copyright">Do not copy my pictures</p>'
        '</body>'
    ),
    (
        '<body><form action="/page.aspx"><div id="menu"><a href="/1">Funds</a> <a href="/2">Bonds</a></div><div class="page"><!--main--><h1>'
        'Quarter ends well</h1><p>The company sold more machines than in any quarter before, and raised its forecast for the year.</p><div class="share-price">'
        'The share closed at 41, two per cent up, after the report.</div><p>Read <a href="/r">the full report</a> for the figures of each plant.</p><!--end-->'
        '</div><div class="footer-links"><a href="/3">Terms</a></div></form></body>'
    ),
    (
        '<body><div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/s">Sport</a></div><main><!--main--><h1>Caring for your feet</h1>'
        '<div class="foot-care"><p>Wash them with warm water every evening and dry them well between the toes.</p><ul><li>Cut the nails straight.</li><li>'
        '<a href="/c">Use a cream</a></li></ul></div><!--end--></main><p>Loose words of the site here</p><div class="story-related-links"><a href="/x">'
        'Ten hikes to take this year</a><br><a href="/y">Shoes that last</a></div></body>'
    ),
    (
        '<body><p><a href="/">Index</a> <a href="/2">Archive</a></p><p>Site search</p><article><header><!--main--><h1>The clock maker</h1></header><p>'
        'He opened the shop in a narrow street when he was twenty, and he never closed it for a day.</p><h2>Tools</h2><p>Small.</p><p>'
        'Most of his tools he made himself, from brass, in the long winters.</p><!--end--></article><p>More stories</p><p><a href="/b">The baker</a></p><p>'
        '<a href="/s">The smith of the old town</a></p></body>'
    ),
    (
        '<body><div class="top-links"><a href="/in">Log in</a></div><!--main--><h1>Up to the hut</h1><div id="story"><p>'
        'We walked from the valley to the hut in six hours, with a rest at the lake, and met nobody on the way.</p><p>'
        'The hut has room for twelve; the key hangs beside the door, and <a href="/w">water</a> comes from the spring behind it.</p><!--end--></div><p>'
        '<a href="/1">Back</a></p><p><a href="/2">Next page</a></p></body>'
    ),
]
_WEIGHTS: dict[str, float] = {}


def default_weights() -> dict[str, float]:
    if not _WEIGHTS:
        _WEIGHTS.update(fit(LABELLED_PAGES))
    return _WEIGHTS


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    learned = weights or default_weights()

    def run(ids: list, urls: list, htmls: list) -> dict:
        texts = [extract(h, learned) for h in htmls]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": list(map(len, texts))}

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), run, "page_id long, url string, text string, n_chars long")
