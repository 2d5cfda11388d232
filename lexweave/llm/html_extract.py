"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tags and runs of words. A word scores +1, a word inside a link less; a tag
scores its weight, which is negative: the log odds, over labelled pages, of standing inside the content
rather than outside, and a small cost for tags that stand inside. One linear scan finds the contiguous region
with the greatest sum. Elements that are never content (menus, forms, scripts, adverts, notices, sidebars,
footers, reader comments), known by name, role, class or id, score nothing and are left out wherever they
stand, so that an advert in the middle doesn't split an article.

A name in class, id or role is read like a compound noun: what it is about stands last, but for words that only say how it
is built (ad-slot, site-footer, related-posts; not share-price-table). Headings are left out for no name of
their own. Inside article and main fewer words count, as the parts of an article are often called header or alert there; and
what begins there is read even within elements whose names speak of the page's layout.

A region inside an article or main element stands for all that is read there, as its edges cut off what a link or a
heading costs too much for; elsewhere it is completed to whole blocks.

Blocks of the region have character references decoded and white space turned into single spaces; they are
joined by line feeds. Nothing else is dropped, and pages of any length are read whole.

Cases: null, empty and content-less pages give an empty text. Broken markup is read like browsers read it in
the main: unclosed elements end with their parent, a stray "<" is text, an unclosed script ends the page.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_labels import PAGES
from .shared import limit_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay inside a line of text.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are read whatever their names say.
READ = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Elements that are never content.
NEVER = frozenset("nav aside form footer button select option dialog menu object canvas audio video head".split())
#: What never is content by its name in class, id or role, wherever it stands.
MARKS = frozenset("ad ads adsense adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars menu menus navbar nav navigation breadcrumb breadcrumbs footer share sharing social comment comments disqus reply replies respond related recommended recommendations newsletter subscribe subscription signup login pagination pager widget widgets skip".split())
#: The same, but only outside article and main.
OUTER_MARKS = MARKS | frozenset("header masthead topbar alert alerts search toolbar".split())
#: Of those, what isn't read even if an article begins in it.
HARD = frozenset("ad ads adsense adsbygoogle advert adverts advertisement advertising comment comments disqus reply replies respond related recommended recommendations".split())
#: Words that only say how something is built or where it stands.
BUILT = frozenset("area bar block body bottom box button buttons card cell col column container content div el element form frame global group holder inner item items label left line link links list module nav outer panel place placeholder post posts right row section site slot space spot stories story table top unit wrap wrapper zone articles".split()) - MARKS - {"table"}
#: Words before a mark by which a name speaks of a layout around it.
AROUND = frozenset("has have with without no not hide is in by".split())
_SPLIT = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
LINK_WORD, TAG_COST, UNKNOWN, LIMIT = 0.2, -0.01, -0.5, -12.0


def _subject(name: str) -> str:
    """What a name in class, id or role is about: its last word that doesn't only say how it is built."""
    words = [w for w in _SPLIT.split(_HUMP.sub(r"\1-\2", name).lower()) if len(w) > 1]
    while len(words) > 1 and words[-1] in BUILT:
        words.pop()
    return words[-1] if words and AROUND.isdisjoint(words) else ""


def _hides(name: str, attributes: str, content: bool) -> int:
    """0 if an element is read, 1 if it is left out, 2 if it is even where an article begins in it."""
    if name in NEVER:
        return 2
    if name == "header" and not content:
        return 1
    out = 0
    if attributes and name not in READ:
        marks = MARKS if content else OUTER_MARKS
        for m in _NAMES.finditer(attributes):
            for subject in map(_subject, (m[1] or m[2] or m[3] or "").split()):
                if subject in marks:
                    out = max(out, 2 if subject in HARD else 1)
    return out


class _Reader:
    """Turns a page into items: (kind, value, start of the item, whether left out, whether in a link)."""

    def __init__(self, html: str):
        self.items: list[tuple[str, str, int, bool, bool]] = []
        self.articles: list[tuple[int, int]] = []  # items of the article and main elements that are read, inner ones first
        stack: list[tuple[str, int]] = []  # open elements and how they are hidden
        opened: list[int] = []  # first items of the open articles
        hidden = [0, 0, 0]  # open elements by that
        at = links = content = 0
        for m in TOKEN.finditer(html):
            out = hidden[2] + hidden[1] > 0
            if m.start() > at:
                self.items.append(("text", html[at : m.start()], at, out, links > 0))
            at = m.end()
            name = (m[3] or "").lower()
            if not name:
                continue
            was = out, links > 0  # an end tag belongs to its element
            if m[2]:
                ends = len(stack) - 1
                while ends >= 0 and stack[ends][0] != name:
                    ends -= 1
            else:
                ends = len(stack) - 1 if name not in INLINE and stack and stack[-1][0] == "p" and name not in VOID else -1
            for n, how in stack[ends:] if ends >= 0 else ():
                links -= n == "a"
                if n in ("article", "main"):
                    content -= 1
                    if (first := opened.pop()) >= 0:
                        self.articles.append((first, len(self.items)))
                if how < 3:
                    hidden[how] -= 1
                else:  # an article within a layout's element: that is hidden again
                    hidden[1] += how - 3
            if ends >= 0:
                del stack[ends:]
            if not m[2] and name not in VOID:
                how = _hides(name, m[4], content > 0)
                if name in ("article", "main") and hidden[1] and not hidden[2]:
                    how, hidden[1] = 3 + hidden[1], 0
                else:
                    hidden[how] += 1
                stack.append((name, how))
                links += name == "a"
                if name in ("article", "main"):
                    content += 1
                    opened.append(-1 if hidden[1] + hidden[2] else len(self.items))
            self.items.append(("tag", name, m.start(), was[0] or hidden[2] + hidden[1] > 0, was[1] or links > 0))
        if at < len(html):
            self.items.append(("text", html[at:], at, hidden[2] + hidden[1] > 0, links > 0))
        self.articles += [(first, len(self.items)) for first in reversed(opened) if first >= 0]


def fit_weights(pages: list[str] = PAGES) -> dict[str, float]:
    """Tag weights from pages whose content stands between [[ and ]]."""
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        first, last = page.index("[["), page.index("]]") - 2
        for kind, name, at, left_out, _ in _Reader(page.replace("[[", "").replace("]]", "")).items:
            if kind == "tag" and not left_out:
                (inside if first <= at < last else outside)[name] += 1
    odds = {t: math.log((inside[t] + 0.5) / (outside[t] + 0.5)) for t in inside | outside}
    return {t: max(LIMIT, x) if x < 0 else TAG_COST for t, x in odds.items()} | {"article": LIMIT, "main": LIMIT, "body": LIMIT}


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first [i, j) with the greatest positive sum, as long as it can be; (0, 0) if none is positive."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, region = total, (start, k + 1)
    return region


def whole(items: list[tuple], articles: list[tuple[int, int]], i: int, j: int) -> tuple[int, int]:
    """The region with the rest of the innermost article that holds it, or else with the rest of its first and last block."""
    if i == j:
        return i, j
    around = [(b - a, a, b) for a, b in articles if a <= i and j <= b]
    if around:
        return min(around)[1:]
    in_line = lambda item: item[0] == "text" or item[1] in INLINE
    while i and in_line(items[i]) and in_line(items[i - 1]):
        i -= 1
    while j < len(items) and in_line(items[j - 1]) and in_line(items[j]):
        j += 1
    return i, j


_WEIGHTS = fit_weights()


def main_text(html: str | None, weights: dict[str, float] = _WEIGHTS) -> str:
    page = _Reader(html or "")
    items, scores = page.items, []
    for kind, value, _, left_out, link in items:
        if left_out:
            scores.append(0.0)
        elif kind == "tag":
            scores.append(weights.get(value, UNKNOWN))
        else:
            scores.append(len(value.split()) * (LINK_WORD if link else 1.0))
    i, j = whole(items, page.articles, *best_region(scores))
    blocks, run = [], []
    for kind, value, _, left_out, _ in [*items[i:j], ("tag", "p", 0, False, False)]:
        if kind == "tag":
            if value not in INLINE:
                if text := " ".join(unescape("".join(run)).split()):
                    blocks.append(text)
                run = []
        elif not left_out:
            run.append(value)
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row. One narrow pass, no shuffle."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    limit_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
