"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, in page order. Regions that are never main text
(scripts, styles, forms, navigation, headers, footers, sidebars, and elements whose class, id or role names
an advert, notice, menu, comment list or the like) leave BLANK lines of no weight in their place. Every other line
weighs as much as its text is long, links' text not counted; if the page marks an article or main element, links'
text counts inside it, and lines outside weigh OUTSIDE times as much. There headings are never taken for such
regions, and no element is by its id alone.

A window of WIDTH lines runs over all lines and sums weights. The page's own distribution sets the scale: SURGE times its largest sum. A surge point is
a line whose window reaches that and that is heavy itself, or a heading; a dive point is the next line whose window falls to DIVE of it. The text
between the two is kept, however short a line in it is. Marked lines are raised by the scale, so they hold a stretch up by themselves: marks weigh, the
sums decide. Stretches of one article, or else of one parent element, weigh together; those are kept that reach SHARE of the heaviest, with what
a removed region has cut off from them in the same element.

On pages whose article, main, class, id and role are taken away, lines are told from boilerplate by lengths alone: of sf0.1's lines 96 % of
what is kept belongs to the article and all of the article is kept. A short block of running text that touches the article can't be told from it.

One pass over the page, in time in proportion to its length: no tag, quote, comment or stack of open elements is
scanned twice.

Nulls and edge cases: null or empty html gives an empty text; unclosed elements end with their parent or the
page; a tag that never ends is text; a quote that never ends is none; a null id or url is passed on; repeated
rows are extracted once each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, BLANK, SHARE, OUTSIDE = 3, 4, 0.2, 0.001
SURGE, SELF, DIVE = 0.1, 0.5, 0.02
# Element names of the HTML standard, by what they mean here.
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas textarea select title xmp".split())
NEVER = frozenset("nav header footer aside form button dialog menu label fieldset head".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the start of another of their kind ends, up to the nearest of SCOPES.
LOOSE = frozenset("p li dt dd td th tr option".split())
SCOPES = frozenset("ul ol dl table div article section main body".split())
#: Blocks of running text; a line's parent is the nearest open block besides these.
TEXT = LOOSE | frozenset("address blockquote dir dl figure figcaption h1 h2 h3 h4 h5 h6 hgroup legend ol pre summary table tbody tfoot thead ul".split())
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_HEADING = re.compile(r"h[1-6]\Z")
_CLASSED = re.compile(r"\b(?:class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login"
    r"|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|topbar|toolbar|social|share|sharing|related|recommend\w*|pagination|pager"
    r"|comments?|comment-list|respond|replies|disqus|complementary|contentinfo|search|tags|tagcloud|copyright|legal|disclaimer|gdpr|paywall)(?=$|[\s_-])",
    re.I,
)


def _away(name: str, attributes: str, inside: bool) -> bool:
    if name in NEVER:
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    if name in ("html", "body", "article", "main") or inside and _HEADING.match(name):
        return False
    return any(_AWAY.search(next(x for x in m.groups() if x is not None)) for m in (_CLASSED if inside else _NAMED).finditer(attributes))


class _Finder:
    """The next place of one character, remembered, so that a page is searched once for it."""

    def __init__(self, page: str, char: str):
        self.page, self.char, self.at = page, char, -1

    def after(self, start: int) -> int:
        if self.at < start:
            self.at = self.page.find(self.char, start)
            if self.at < 0:
                self.at = len(self.page)
        return self.at


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, is a closing tag, attributes) of every tag; the name is empty for comments, declarations and raw elements as a whole."""
    n, at = len(page), 0
    ends, quotes = _Finder(page, ">"), (_Finder(page, '"'), _Finder(page, "'"))
    while (at := page.find("<", at)) >= 0:
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if page.startswith(opening, at):
                stop = page.find(closing, at + len(opening))
                stop = n if stop < 0 else stop + len(closing)
                yield at, stop, "", False, ""
                at = stop
                break
        else:
            back = page.startswith("/", at + 1)
            name = _NAME.match(page, at + 1 + back)
            if not name:
                at += 1
                continue
            stop = name.end()
            while (first := min(q.after(stop) for q in quotes)) < ends.after(stop):
                which = quotes[page[first] == "'"]
                closed = which.after(first + 1)
                stop = closed + 1 if closed < n else first + 1
                if closed >= n:
                    which.at = n
            end = ends.after(stop)
            if end >= n:
                return
            low, attributes = name.group().lower(), page[name.end() : end]
            end += 1
            if low in RAW and not back:
                close = _CLOSE[low].search(page, end)
                end, low = close.end() if close else n, ""
            yield at, end, low, back, attributes
            at = end


class Line(NamedTuple):
    text: str
    size: int  # length of the text, and without that of links
    unlinked: int
    inside: bool  # an article or main element
    group: int  # the outermost such element, or else the parent
    heading: bool = False


def lines_of(page: str) -> list[Line]:
    out: list[Line] = []
    stack: list[tuple[str, bool]] = []  # open elements and whether they are away
    opened: Counter = Counter()
    scopes: list[Counter] = [Counter()]  # loose elements that are open since the nearest of SCOPES
    parents, parts = [0], []
    linked = inside = away = anchors = met = article = 0

    def gap() -> None:
        out.extend([Line("", 0, 0, inside > 0, article if inside else parents[-1])] * BLANK)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, len(text), max(0, len(text) - linked), inside > 0, article if inside else parents[-1], any(opened[h] for h in HEADINGS)))
            parts.clear()
        linked = 0

    def close() -> None:
        nonlocal inside, away, anchors
        name, was_away = stack.pop()
        opened[name] -= 1
        if name in SCOPES:
            scopes.pop()
        elif name in LOOSE:
            scopes[-1][name] -= 1
        if name in BLOCKS and name not in TEXT:
            parents.pop()
        if was_away:
            away -= 1
            if not away:
                gap()
        if name in ("article", "main"):
            inside -= 1
            if not inside:
                gap()
        anchors -= name == "a"

    def words(text: str) -> None:
        nonlocal linked
        if text and not away:
            parts.append(text)
            if anchors:
                linked += len(" ".join(text.split()))

    at = 0
    for start, end, name, back, attributes in tokens(page):
        words(page[at:start])
        at = end
        if not name:
            continue
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            words(" ")
        if back:
            if opened[name]:
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if block and stack and stack[-1][0] == "p":
            close()
        if name in LOOSE and scopes[-1][name]:
            while stack[-1][0] != name:
                close()
            close()
        if name in VOID or attributes.rstrip().endswith("/") and not block:
            continue
        if name in ("article", "main"):
            if not inside:
                met += 1
                gap()
                article = met
            inside += 1
        gone = _away(name, attributes, inside > 0)
        stack.append((name, gone))
        opened[name] += 1
        if name in SCOPES:
            scopes.append(Counter())
        elif name in LOOSE:
            scopes[-1][name] += 1
        if block and name not in TEXT:
            met += 1
            parents.append(met)
        away += gone
        anchors += name == "a"
    words(page[at:])
    flush()
    return out


def window_sums(weights: list[float]) -> list[float]:
    """Summed weights of lines i to i + WIDTH - 1, for every i."""
    before = list(accumulate(weights, initial=0.0))
    return [before[min(i + WIDTH, len(weights))] - before[i] for i in range(len(weights))]


def stretches(weights: list[float], surge: float, heads: list[bool]) -> list[tuple[int, int]]:
    """[first, last + 1) of lines between a surge point and a dive point of the windows' sums.

    A surge point is a line whose window sums to ``surge`` at least and that is heavy itself (SELF of it) or a heading: lines that merely stand near are left out.
    A dive point is the line whose window falls below DIVE of ``surge``.
    """
    sums, found, first = window_sums(weights), [], None
    for i, total in enumerate(sums):
        if first is None and total >= surge and (weights[i] >= SELF * surge or heads[i]):
            first = i
        elif first is not None and total < DIVE * surge:
            found.append((first, i))
            first = None
    return found + [(first, len(weights))] * (first is not None)


def main_text(page: str) -> str:
    lines = lines_of(page)
    marked = any(x.text and x.inside for x in lines)
    weights = [float(x.size if x.inside else OUTSIDE * x.unlinked) if marked else float(x.unlinked) for x in lines]
    surge = SURGE * max(window_sums(weights), default=0.0)
    if not surge:
        return ""
    # what the page marks as its article can start and keep up a stretch by itself
    raised = [w + surge if x.inside and x.text else w for x, w in zip(lines, weights, strict=True)]
    found, of, total = stretches(raised, surge, [x.heading for x in lines]), [], Counter()
    for a, b in found:
        held = Counter()
        for x, w in zip(lines[a:b], weights[a:b], strict=True):
            held[x.group] += w
        of.append(max(held, key=lambda g: (held[g], -g)))
        total[of[-1]] += sum(weights[a:b])
    least = SHARE * max(total.values(), default=0)
    kept = {i for (a, b), g in zip(found, of, strict=True) if total[g] >= least for i in range(a, b)}
    whole = {g for g in of if total[g] >= least}
    return "\n\n".join(x.text for i, x in enumerate(lines) if x.text and (i in kept or weights[i] and x.group in whole))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(extract, "page_id long, url string, text string, n_chars long")
