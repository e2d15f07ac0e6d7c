"""Main text of web pages: flat text blocks, described with their neighbours and classified by a decision tree."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that never hold readable text, those of them that run to the page's end where they aren't closed,
# elements that end a block, and elements without an end tag.
SILENT = "script style noscript template svg iframe object select button textarea title canvas audio video map datalist".split()
RAW = "script style textarea title".split()
BLOCK = (
    "html head body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main nav aside header "
    "footer form fieldset legend blockquote pre figure figcaption address hr details summary dialog center menu"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Roles and words of class or id names that mark what isn't the article.
MARKED = (
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "comment comments respond reply replies disqus discussion sidebar side related recommended recommendations share sharing social subscribe "
    "subscription newsletter signup login search nav navbar navigation menu breadcrumb breadcrumbs pager pagination footer foot header head "
    "masthead toolbar widget widgets popup modal overlay copyright legal disclaimer tags taglist skip complementary contentinfo"
).split()
# Words that may stand beside those in such a name; with any other word the place of the marked word decides.
BESIDE = (
    "area bar block bottom box button buttons center col column container element footer global group holder inner item items layout left link links "
    "list module outer page panel primary right row secondary section site small strip text top unit view wrap wrapper"
).split()
# Words that mark an element as the first or last word of its name, words before which the first one
# doesn't, and first words that say that the page has such a part, or doesn't.
AT_ENDS = (
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr comment comments disqus sidebar "
    "newsletter nav navbar navigation breadcrumb breadcrumbs pagination pager"
).split()
AT_THE_END = "footer menu widget popup modal overlay related recommended recommendations share sharing social subscribe signup login taglist disclaimer replies".split()
ABOUT = "article story post recipe recipes page".split()
HAVING = "has have with without no not show hide is free".split()

#: The inside of a tag: quotes enclose a value only right after an equals sign.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/])" + _REST + r"(?<=/)>"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + _REST + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>" + _REST + r")>|<[!?/][^>]*>",
    re.I | re.S,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLOSED = re.compile(r"(?:^|[\s\"'])/$|^[^=]*/$")  # a slash that isn't the end of an unquoted value
_QUIET = {x for x in SILENT if x not in RAW}
_SPACE = re.compile(r"\s+")

#: What the tree sees of a block.
FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_article", "page_has_article", "marked", "heading", "item")

#: The labelled table that the tree learns from: blocks judged by hand, features as above, then 1 for main text.
LABELLED = (
    # marked blocks: menus, adverts, notices, forms, footers, side bars, sharing, reader comments; with and without an article element
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 1, 0), (3, 1.0, 2, 1.0, 8, 0.0, 0, 1, 1, 0, 1, 0),
    (4, 0.75, 0, 0.0, 12, 0.0, 0, 1, 1, 0, 0, 0), (9, 0.0, 1, 1.0, 11, 0.0, 0, 1, 1, 0, 0, 0), (24, 0.1, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 0, 0),
    (45, 0.05, 60, 0.0, 80, 0.0, 0, 0, 1, 0, 0, 0), (30, 0.0, 5, 0.5, 40, 0.0, 1, 1, 1, 0, 0, 0), (14, 0.3, 0, 0.0, 3, 1.0, 0, 0, 1, 0, 0, 0),
    (18, 0.0, 90, 0.0, 0, 0.0, 0, 1, 1, 0, 0, 0), (70, 0.1, 50, 0.0, 0, 0.0, 0, 1, 1, 0, 0, 0), (4, 0.0, 0, 0.0, 2, 1.0, 0, 1, 1, 1, 0, 0),
    (3, 0.0, 60, 0.0, 12, 0.0, 0, 1, 1, 1, 0, 0), (25, 0.2, 4, 0.0, 30, 0.2, 0, 1, 1, 0, 0, 0), (35, 0.0, 2, 0.0, 28, 0.0, 1, 1, 1, 0, 0, 0),
    (50, 0.0, 3, 0.0, 40, 0.0, 0, 1, 1, 0, 0, 0), (110, 0.0, 80, 0.0, 60, 0.0, 1, 1, 1, 0, 0, 0), (10, 1.0, 40, 0.0, 9, 1.0, 1, 1, 1, 0, 1, 0),
    (6, 0.0, 50, 0.0, 30, 0.0, 1, 1, 1, 1, 0, 0), (60, 0.0, 60, 0.0, 60, 0.0, 0, 0, 1, 0, 0, 0), (3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0),
    (12, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1, 0, 0, 0), (80, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0), (5, 0.0, 3, 0.0, 70, 0.0, 1, 1, 1, 0, 1, 0),
    # unmarked blocks beside the article element
    (20, 0.0, 3, 0.3, 55, 0.0, 0, 1, 0, 0, 0, 0), (60, 0.0, 40, 0.0, 20, 0.0, 0, 1, 0, 0, 0, 0), (5, 0.0, 2, 0.0, 3, 0.0, 0, 1, 0, 0, 0, 0),
    (2, 0.0, 30, 0.0, 4, 1.0, 0, 1, 0, 1, 0, 0), (3, 1.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 0), (90, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 0),
    (8, 0.0, 0, 0.0, 60, 0.0, 0, 1, 0, 1, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0, 1, 0),
    # head lines, paragraphs and items of the article element, long and short
    (9, 0.0, 8, 0.0, 60, 0.0, 1, 1, 0, 1, 0, 1), (4, 0.0, 2, 1.0, 45, 0.0, 1, 1, 0, 1, 0, 1), (14, 0.0, 0, 0.0, 2, 0.0, 1, 1, 0, 1, 0, 1),
    (60, 0.0, 9, 0.0, 70, 0.0, 1, 1, 0, 0, 0, 1), (120, 0.02, 60, 0.0, 15, 0.1, 1, 1, 0, 0, 0, 1), (80, 0.1, 40, 0.0, 0, 0.0, 1, 1, 0, 0, 0, 1),
    (3, 0.0, 50, 0.0, 60, 0.0, 1, 1, 0, 0, 0, 1), (1, 0.0, 20, 0.0, 12, 0.0, 1, 1, 0, 0, 0, 1), (2, 0.0, 4, 0.0, 10, 0.0, 1, 1, 0, 0, 0, 1),
    (25, 0.3, 30, 0.1, 22, 0.0, 1, 1, 0, 0, 0, 1), (7, 0.0, 12, 0.0, 9, 0.0, 1, 1, 0, 0, 1, 1), (2, 0.0, 3, 0.0, 2, 0.0, 1, 1, 0, 0, 1, 1),
    (40, 0.0, 50, 0.0, 1, 1.0, 1, 1, 0, 0, 0, 1), (2, 0.0, 5, 1.0, 2, 1.0, 1, 1, 0, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0, 0, 0, 1),
    # linked paragraphs and lists of links (chapters, sources) in the article element
    (3, 1.0, 40, 0.0, 50, 0.0, 1, 1, 0, 0, 0, 1), (7, 0.86, 30, 0.0, 25, 0.0, 1, 1, 0, 0, 0, 1), (25, 1.0, 30, 0.0, 40, 0.0, 1, 1, 0, 0, 0, 1),
    (4, 1.0, 3, 1.0, 5, 1.0, 1, 1, 0, 0, 1, 1), (2, 1.0, 20, 0.0, 2, 1.0, 1, 1, 0, 0, 1, 1), (3, 1.0, 3, 1.0, 0, 0.0, 1, 1, 0, 0, 1, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 1, 0, 0, 1, 1), (15, 0.4, 20, 0.0, 2, 1.0, 1, 1, 0, 0, 0, 1),
    # pages without an article element: head lines and paragraphs, alone and among others
    (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (60, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1, 0, 1), (2, 0.0, 60, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 1),
    (60, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 1),
    (55, 0.0, 12, 0.0, 48, 0.0, 0, 0, 0, 0, 0, 1), (90, 0.05, 60, 0.0, 8, 0.4, 0, 0, 0, 0, 0, 1), (30, 0.1, 55, 0.0, 42, 0.0, 0, 0, 0, 0, 0, 1),
    (12, 0.0, 3, 1.0, 50, 0.0, 0, 0, 0, 1, 0, 1), (4, 0.0, 1, 1.0, 30, 0.0, 0, 0, 0, 1, 0, 1), (7, 0.0, 70, 0.0, 65, 0.0, 0, 0, 0, 1, 0, 1),
    (160, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0, 0, 0, 1), (22, 0.0, 35, 0.0, 28, 0.1, 0, 0, 0, 0, 1, 1), (5, 0.0, 6, 0.0, 4, 0.0, 0, 0, 0, 0, 1, 1),
    (40, 0.2, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0, 1), (60, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (9, 0.3, 30, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1), (4, 0.0, 30, 0.0, 6, 1.0, 0, 0, 0, 0, 0, 1), (10, 0.0, 25, 0.0, 20, 1.0, 0, 0, 0, 0, 0, 1),
    (14, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (3, 0.0, 40, 0.0, 10, 0.0, 0, 0, 0, 0, 0, 1), (2, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0, 0, 1),
    # and their linked paragraphs between text
    (3, 1.0, 60, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 1), (20, 1.0, 30, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 1), (7, 0.86, 25, 0.0, 30, 0.1, 0, 0, 0, 0, 0, 1),
    (3, 1.0, 2, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 1), (4, 1.0, 5, 0.0, 35, 0.0, 0, 0, 0, 0, 0, 1), (6, 1.0, 9, 0.0, 50, 0.0, 0, 0, 0, 0, 0, 1),
    (5, 0.8, 12, 0.0, 15, 0.0, 0, 0, 0, 0, 0, 1), (9, 1.0, 80, 0.1, 40, 0.2, 0, 0, 0, 0, 0, 1),
    # and their menus and lists of links, first, middle and last ones, with what stands among them
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 1, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 1, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 0, 0, 0, 1, 0),
    (9, 0.9, 7, 1.0, 8, 1.0, 0, 0, 0, 0, 1, 0), (12, 0.8, 10, 0.9, 11, 0.9, 0, 0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0, 1, 0),
    (3, 1.0, 3, 1.0, 9, 0.0, 0, 0, 0, 0, 1, 0), (3, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 1, 0), (4, 1.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1, 0),
    (3, 1.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 5, 0.0, 0, 0, 0, 1, 0, 0),
    (3, 1.0, 3, 1.0, 60, 0.0, 0, 0, 0, 0, 1, 0), (4, 1.0, 5, 1.0, 80, 0.0, 0, 0, 0, 0, 0, 0), (6, 1.0, 4, 1.0, 45, 0.0, 0, 0, 0, 0, 1, 0),
    (1, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 1, 0), (2, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 1, 0, 0), (2, 0.0, 60, 0.0, 4, 1.0, 0, 0, 0, 1, 0, 0),
    (3, 0.0, 45, 0.0, 3, 1.0, 0, 0, 0, 1, 0, 0), (25, 1.0, 4, 1.0, 20, 1.0, 0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1):
    """A decision tree by Gini gain: (feature, cut, tree below, tree above) or the share of class 1."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return float(y.mean())
    gini = lambda s: len(s) * 2 * s.mean() * (1 - s.mean()) if len(s) else 0.0
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            under = x[:, f] < cut
            if min(under.sum(), (~under).sum()) >= least:
                gain = gini(y) - gini(y[under]) - gini(y[~under])
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, cut)
    if best is None or best[0] <= 1e-12:
        return float(y.mean())
    _, f, cut = best
    under = x[:, f] < cut
    return f, cut, grow(x[under], y[under], depth - 1, least), grow(x[~under], y[~under], depth - 1, least)


def decide(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


@lru_cache(maxsize=4)
def trained(table=LABELLED):
    rows = np.array(table, float)
    return grow(rows[:, :-1], rows[:, -1])


def _words(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]


@lru_cache(maxsize=1 << 14)
def _marking(name: str) -> frozenset[str]:
    """The words by which a role, class or id name marks what isn't the article."""
    parts = _words(name)
    if not parts or len(parts) > 1 and parts[0] in _HAVING:
        return frozenset()
    found = _MARKED.intersection(parts) if _MAY_STAND.issuperset(parts) else set()
    if parts[0] in _AT_ENDS and parts[-1] not in _ABOUT:
        found.add(parts[0])
    if parts[-1] in _AT_ENDS or parts[-1] in _AT_THE_END and len(parts) > 1:
        found.add(parts[-1])
    return frozenset(found)


def _marks(tag: str, rest: str) -> tuple[set[str], set[str]]:
    """Words on an element that mark what isn't the article, and its roles."""
    found, roles = set(), set()
    for m in _NAMES.finditer(rest) if tag not in ("html", "body") else ():
        value = m[2] or m[3] or m[4] or ""
        roles |= set(value.lower().split()) if m[1].lower() == "role" else set()
        for name in value.split():
            found |= _marking(name)
    return found, roles


_MAY_STAND, _AT_ENDS, _AT_THE_END, _ABOUT, _HAVING = {*MARKED, *BESIDE}, set(AT_ENDS), set(AT_THE_END), set(ABOUT), set(HAVING)
_MARKED, _BLOCK, _VOID, _HEADING = set(MARKED), set(BLOCK), set(VOID), {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening block ends: an open element of the first kind, if none of the others was opened after it.
_ENDS_P = ("p", ("article", "main", "div", "td", "li", "section", "blockquote", "body"))
_ENDS_ITEM = ("li", ("ul", "ol", "menu"))
_QUIET_END = re.compile(r"</(" + "|".join(x for x in SILENT if x not in RAW) + r")\s*>", re.I)


class _Open:
    """The open elements, outermost first, and where each tag and the innermost block stand among them, so that no end
    tag has to look through them all."""

    OUTSIDE = (0, False, False, False, False)  # in main (1) or article (2), marked, heading, item, in link

    def __init__(self):
        self.elements: list[tuple] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.state = self.OUTSIDE

    def last(self, tag: str) -> int:
        return (self.places.get(tag) or (-1,))[-1]

    def push(self, tag: str, state: tuple):
        self.places.setdefault(tag, []).append(len(self.elements))
        if tag in _BLOCK:
            self.blocks.append(len(self.elements))
        self.elements.append((tag, state))
        self.state = state

    def pop_to(self, i: int):
        while len(self.elements) > i:
            tag, _ = self.elements.pop()
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
        self.state = self.elements[-1][1] if self.elements else self.OUTSIDE

    def end(self, tag: str):
        i = self.last(tag)
        if i >= 0 and (tag in _BLOCK or not self.blocks or self.blocks[-1] < i):
            self.pop_to(i)

    def ended_by_block(self, closing: str, stops: tuple[str, ...]):
        i = self.last(closing)
        if i > max(map(self.last, stops)):
            self.pop_to(i)


def blocks(html: str) -> list[list]:
    """[text, words, words in links, in main (1) or article (2), marked, heading, item] of the flat text blocks in page
    order. The time is linear in the page: an element without readable text is passed over if its end tag comes later on
    the page, and is read as a plain tag otherwise."""
    out: list[list] = []
    pieces: list[tuple[str, bool]] = []
    open_, quiet = _Open(), None

    def close():
        if pieces:
            text = _SPACE.sub(" ", unescape("".join(p for p, _ in pieces))).strip()
            if text:
                linked = sum(len(unescape(p).split()) for p, link in pieces if link)
                out.append([text, len(text.split()), linked, *open_.state[:4]])
            pieces.clear()

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            pieces.append((html[at : m.start()], open_.state[4]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _QUIET and not m["end"]:
            if quiet is None:
                quiet = {}
                for e in _QUIET_END.finditer(html):
                    quiet.setdefault(e[1].lower(), []).append(e)
            ends = quiet.get(tag, [])
            i = bisect_left(ends, at, key=lambda e: e.start())
            if i < len(ends) and not (tag == "svg" and m["rest"].endswith("/")):
                if tag in _BLOCK:
                    close()
                at = ends[i].end()
            continue
        if tag == "br":
            pieces.append((" ", False))
        if tag in _BLOCK:
            close()
        if m["end"]:
            open_.end(tag)
            continue
        if tag in _BLOCK:
            open_.ended_by_block(*_ENDS_P)
            if tag == "li":
                open_.ended_by_block(*_ENDS_ITEM)
        if tag in _VOID or tag not in _BLOCK and _CLOSED.search(m["rest"]):
            continue
        inside, marked, heading, item, link = open_.state
        names, roles = _marks(tag, m["rest"])
        if inside:
            names -= {"header", "head", "alert"}
        own = bool(names) or tag in ("nav", "aside", "footer", "form", "dialog", "menu") or tag == "header" and not inside
        if not own and not marked:
            inside = max(inside, 2 if tag == "article" or "article" in roles else 1 if tag == "main" or "main" in roles else 0)
        open_.push(tag, (inside, marked or own, heading or tag in _HEADING, item or tag in ("li", "dd", "dt", "td"), link or tag == "a"))
    if at < len(html):
        pieces.append((html[at:], open_.state[4]))
    close()
    return out


def describe(found: list[list]) -> list[tuple]:
    """The features of each block, with those of its neighbours."""
    inside = lambda least: sum(b[1] for b in found if b[3] >= least and not b[4])
    # small articles in a large main element (teasers) aren't the article
    least = 2 if inside(2) and 4 * inside(2) >= inside(1) else 1
    has = inside(least) > 0
    edge = ["", 0, 0]
    density = lambda b: b[2] / b[1] if b[1] else 0.0
    out = []
    for before, b, after in zip([edge, *found], found, [*found[1:], edge]):
        out.append((b[1], density(b), before[1], density(before), after[1], density(after), b[3] >= least, has, b[4], b[5], b[6]))
    return out


def main_text(html: str | None, tree=None) -> str:
    """The blocks that the tree takes for main text, one a line; null and empty pages give an empty text."""
    found = blocks(html or "")
    tree = tree or trained()
    return "\n".join(b[0] for b, x in zip(found, describe(found)) if decide(tree, x) >= 0.5)


def extract(pages: DataFrame, table=LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html. Blocks end at block elements; character
    references are decoded, white space inside a block becomes one space. Null html counts as empty; repeated rows give
    repeated rows; an empty table gives no rows; other columns are ignored."""

    def run(batches):
        tree = trained(table)
        for b in batches:
            texts = [main_text(h.as_py(), tree) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark, sf_dir):
    from .common import read

    return extract(read(spark, sf_dir, "pages"))
