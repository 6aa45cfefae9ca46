"""Main text of a web page by the distribution of text over its lines.

Markup is stripped into lines, one for each block element. Elements that never hold article text
(scripts, menus, asides, footers) leave a break, and so do blocks whose class or id says advert, comment and the
like, unless the article is inside or they hold most of the text. The text lengths are summed over windows
of three lines. Text starts where such a sum surges above the threshold and ends where it dives to zero; of all
stretches found so, the one with most text is the article, with others that have at least a third of it. All
lines within a stretch stay, also those of links.

Lines most of whose text is links weigh nothing. Where a page marks its article (an article or main element, or such a class
or id), the lines in it weigh more, so that its short lines carry a stretch too, and those outside are breaks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolecast.llm.common import slices

WINDOW = 3
SURGE = 80
LINK_SHARE = 0.5
#: An element with more than this share of the text is not unwanted for its name alone.
MOST = 0.5

# Names of elements and words of class and id attributes.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"))
DROPPED = frozenset(("script", "style", "noscript", "template", "head", "nav", "footer", "aside", "button", "select", "textarea", "iframe", "svg", "math", "canvas", "object", "menu", "audio", "video", "map", "title"))
DOUBTFUL = frozenset(("form", "dialog", "fieldset", "label", "header"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
SECTIONS = frozenset(("article", "main", "section", "nav", "header", "footer", "aside", "body", "html", "form"))
UNWANTED = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "discussion", "disqus",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pagination", "paywall", "popup",
    "promo", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"))
MARKED = frozenset(("article", "main"))
MARKED_NAMES = frozenset(("article", "article-body", "article-content", "content", "entry", "entry-content", "main", "main-content", "post", "post-content", "story", "story-body"))

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*\'|[\"'])*?)(/?)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PART = re.compile(r"[^a-z0-9]+")


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")).lower() for k, v in _ATTRIBUTE.findall(source)} if source.strip() else {}


def _unwanted(name: str, attributes: dict[str, str]) -> int:
    """2: never article text; 1: not if the article is in it; 0: may be text."""
    if name in DROPPED:
        return 2
    if name in ("html", "body", "article", "main"):
        return int(name == "article" and bool(_words(attributes) & UNWANTED))
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return 2
    return int(name in DOUBTFUL or attributes.get("role") in ROLES or bool(_words(attributes) & UNWANTED))


def _words(attributes: dict[str, str]) -> set[str]:
    return {w for a in ("class", "id") for w in _NAME_PART.split(attributes.get(a, ""))}


def _marks(name: str, attributes: dict[str, str]) -> int:
    """2: said to be the main element; 1: said to be an article; 0: not marked."""
    if name == "main" or attributes.get("role") == "main":
        return 2
    return int(name in MARKED or bool({attributes.get("id", ""), *attributes.get("class", "").split()} & MARKED_NAMES))


class _Element(NamedTuple):
    start: int
    end: int
    size: int
    level: int  # see ``_unwanted``
    marks: int
    doubts: int  # unwanted elements around it, itself included


def _elements(tokens: list[tuple[str, str, str]], closes: dict[int, int]) -> tuple[dict[int, _Element], int]:
    """Elements that are marked or unwanted, outside those that are dropped anyhow, by their first token; and the length of all text."""
    sums = np.cumsum([0, *[len("".join(value.split())) if kind == "text" else 0 for kind, _, value in tokens]])
    found: dict[int, _Element] = {}
    around: list[int] = []  # ends of the unwanted elements around
    total = int(sums[-1])
    at = 0
    while at < len(tokens):
        kind, name, value = tokens[at]
        if kind == "start" and name not in VOID:
            while around and around[-1] < at:
                around.pop()
            attributes, end = _attributes(value), closes[at]
            level, size = _unwanted(name, attributes), int(sums[end + 1] - sums[at])
            if level == 2:
                total -= size
                found[at] = _Element(at, end, size, 2, 0, 0)
                at = end + 1
                continue
            if level:
                around.append(min(end, around[-1]) if around else end)
            if level or _marks(name, attributes):
                found[at] = _Element(at, end, size, level, _marks(name, attributes), len(around))
        at += 1
    return found, total


def _articles(elements: dict[int, _Element]) -> list[_Element]:
    """The marked elements that are the article: the one with most weight, with others of at least a third of it.

    The weight is the length of the text, four times as much for a main element and a quarter for each unwanted name
    on or around it.
    """
    weight = lambda e: e.size * 4.0 ** ((e.marks == 2) - e.doubts)
    marked = sorted((e for e in elements.values() if e.marks and e.size), key=lambda e: (-weight(e), e.start))
    kept: list[_Element] = []
    for e in marked:
        if 3 * weight(e) >= weight(marked[0]) and not any(k.start <= e.start and e.end <= k.end for k in kept):
            kept = [k for k in kept if not (e.start <= k.start and k.end <= e.end)] + [e]
    return kept


class _Line:
    __slots__ = ("parts", "links", "marked", "wall")

    def __init__(self, marked: bool, wall: bool = False) -> None:
        self.parts: list[str] = []
        self.links = 0
        self.marked, self.wall = marked, wall


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, length that counts, is in the marked article) of each line with text; a break is an empty line."""
    tokens = list(_tokens(page))
    closes = _matches(tokens)
    elements, total = _elements(tokens, closes)
    articles = _articles(elements)

    def dropped(e: _Element) -> bool:
        if e.level < 2:
            if any(e.start <= a.start and a.end <= e.end for a in articles):
                return False
            around = [a for a in articles if a.start <= e.start and e.end <= a.end]
            if name == "header" and around:
                return False  # the head of the article itself
            if around or not articles:
                return e.size <= MOST * (around[0].size if around else total)
        return e.level > 0

    out: list[_Line] = [_Line(False)]
    links = 0
    at = 0
    inside = lambda: any(a.start <= at <= a.end for a in articles)
    while at < len(tokens):
        kind, name, value = tokens[at]
        if kind == "text":
            out[-1].parts.append(value)
            if links:
                out[-1].links += len("".join(value.split()))
        elif kind == "start":
            if at in elements and dropped(elements[at]):
                if name in BLOCKS or name not in ("button", "label", "svg", "script", "style", "select", "noscript"):
                    out += [_Line(False, True), _Line(inside())]
                at = closes[at] + 1
                continue
            if name in BLOCKS:
                out.append(_Line(inside()))
            elif name == "br":
                out[-1].parts.append(" ")
            links += name == "a"
        elif name == "a":
            links = max(0, links - 1)
        elif name in BLOCKS:
            at += 1
            out.append(_Line(inside()))
            at -= 1
        at += 1
    result: list[tuple[str, int, bool]] = []
    for line in out:
        text = " ".join(entities.unescape("".join(line.parts)).split())
        if text and (line.marked or not articles):
            size = len(text.replace(" ", ""))
            result.append((text, 0 if line.links > LINK_SHARE * size else size, line.marked))
        elif (text or line.wall) and result and result[-1][0]:
            result.append(("", 0, False))
    return result


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    at = 0
    while at < len(page):
        found = _TAG.search(page, at)
        if found is None:
            break
        if found.start() > at:
            yield "text", "", page[at : found.start()]
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            yield "end", name, ""
            continue
        yield "start", name, found[3]
        if name in RAW and not found[4]:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if close is None:
                return
            at = close.end()
            yield "end", name, ""
    if at < len(page):
        yield "text", "", page[at:]


def _matches(tokens: list[tuple[str, str, str]]) -> dict[int, int]:
    """The end of each element: its own end tag, else before the next section, else the last token."""
    found: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for at, (kind, name, _) in enumerate(tokens):
        if kind == "start" and name not in VOID:
            waiting.setdefault(name, []).append(at)
        elif kind == "end" and waiting.get(name):
            found[waiting[name].pop()] = at
    sections = [at for at, (kind, name, _) in enumerate(tokens) if kind != "text" and name in SECTIONS]
    for left in waiting.values():
        for at in left:
            later = np.searchsorted(sections, at, side="right")
            found[at] = sections[later] - 1 if later < len(sections) else len(tokens) - 1
    return found


def stretches(weights: np.ndarray, window: int, surge: int) -> list[tuple[int, int]]:
    """(first, behind the last) line of each stretch: from a surge of the windows' sums to where they dive to zero.

    Short lines right before the surge, such as a title, belong to it, up to the last break or line of links.
    """
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(window, np.int64))[window - 1 :]
    surge = min(surge, int(sums.max()))
    found: list[tuple[int, int]] = []
    at = 0
    while at < len(sums):
        if weights[at] and sums[at] >= surge:
            begin = end = at
            while begin > (found[-1][1] if found else 0) and weights[begin - 1]:
                begin -= 1
            while end < len(sums) and sums[end] > 0:
                end += 1
            found.append((begin, end))
            at = end
        else:
            at += 1
    return found


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive; empty if there is none."""
    rows = lines(page) if page else []
    # A line of the marked article carries a stretch by itself.
    weights = np.array([size + surge if marked else size for _, size, marked in rows], np.int64)
    if not weights.sum():
        return ""
    found = stretches(weights, window, surge)
    most = max(int(weights[a:b].sum()) for a, b in found)
    return "\n".join(r[0] for a, b in found if 3 * int(weights[a:b].sum()) >= most or rows[a][2] for r in rows[a:b] if r[0])


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns but ``html``, and ``text``: the article of each page.

    Row by row on whole pages. NULL, empty and text-free pages give an empty text; broken markup
    (missing end tags, stray quotes) is read as far as it goes; repeated rows give equal
    texts; a column already called ``text`` is replaced. An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), text.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count in slices(batch.column(0), 4 << 20):
                part = batch.slice(first, count)
                found = [main_text(p or "") for p in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.string())], names=[*kept, text])

    return pages.select(pages[html].alias("_html_"), *kept).mapInArrow(run, pages.select(*kept).schema.add(text, "string"))
