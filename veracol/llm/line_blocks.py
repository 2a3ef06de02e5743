"""Main text of HTML pages by line-block distribution.

A page is read as if each tag of a container stood on a line of its own and each paragraph, heading or list item
on one line. Stripping the markup leaves lines of text and empty lines. A line counts with its characters outside
of links, a line of links alone with none. The counts are summed over a window that slides over the lines: where
the sum surges the main text begins, where it dives the text ends, and both points move to the nearest empty line, so
that a heading before the surge and a short close before the dive stay with their neighbours.

Markup only prepares the lines. Elements that are no content wherever they stand (scripts, menus, forms, elements
marked as adverts, notices, comments ...) are cut out first and end a line. Where a page has an article or main element, lines
outside of it count nothing, and inside of it any text is a surge.

Defined cases: null or empty html, or a page without text, gives an empty string; a page of any length is read
whole, in time that grows with its length; a page whose lines never surge gives those of its highest window;
unclosed tags end at the next block, an unclosed menu or advert at the article or the end of the body, an unclosed
head at the body or its first block; repeated rows are extracted one by one; an empty table gives an empty
result; only page_id, url and html are read, so extra columns cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, the sum from which on it surges and the one at or under which it dives, calibrated on pages
#: whose article, menu and footer elements and class names had been made plain div elements (see README).
WINDOW, SURGE_CHARS, DIVE_CHARS = 3, 180, 150
#: Characters within which quotes of a tag are paired; a longer tag ends at its first closing bracket.
LONGEST_TAG = 4096

#: Elements whose text is no text of the page at all.
RAW = frozenset("script style noscript template iframe svg textarea title select object canvas audio video math".split())
#: Elements that are no content wherever they stand.
ASIDE = frozenset("nav footer aside form menu dialog button".split())
#: Elements that hold others: their tags stand on lines of their own.
CONTAINERS = frozenset(
    "address article aside blockquote body center details dir div dl fieldset figure footer form header html legend main menu nav ol "
    "optgroup section table tbody td tfoot th thead tr ul".split()
)
#: Elements of one line.
LINES = frozenset("caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr li option p pre summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that mark an element as no content in a name of its class or role, or in its id.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted related "
    "replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside them in such a name; any other word makes it another thing (no-sidebar, search-results).
BESIDE = frozenset(
    "area bar block bottom box buttons column consent container content form global group header inner inline item left links list main nav outer page panel "
    "post posts primary reader right section secondary site slot the thread top unit user wrap wrapper".split()
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>")
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Line:
    text: str
    #: Characters outside of links.
    count: int
    article: bool


_GAP = Line("", 0, False)


def _marked(name: str) -> bool:
    words = [w for w in _WORDS.findall(name) if not w.isdigit()]
    return any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words)


def _no_content(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if "=" not in attributes or tag in ("body", "html", "article", "main"):
        return False
    return any(_marked(name) for _, *values in _NAMES.findall(attributes) for name in "".join(values).lower().split())


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; the name is empty for what is no element's tag: a comment,
    a declaration, or an element of RAW with all that it holds."""
    low, at, last = page.lower(), page.find("<"), page.rfind(">")
    if len(low) != len(page):
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), page)
    while at >= 0:
        m = _NAME.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), at) and at < last:
                end = page.find(">", at) + 1
            else:
                at = page.find("<", at + 1)
                continue
            yield at, end, "", False, ""
        elif at > last:
            return
        else:
            rest = _REST.match(page, m.end(), min(len(page), m.end() + LONGEST_TAG))
            end = rest.end() if rest else page.find(">", m.end()) + 1
            name, attributes, closing = m[1].lower(), page[m.end() : end - 1], page[at + 1] == "/"
            if name in RAW and not closing and not attributes.endswith("/"):
                shut = low.find("</" + name, end)
                while shut >= 0 and low[shut + 2 + len(name) : shut + 3 + len(name)] not in ("", ">", "/", " ", "\n", "\t", "\r", "\f"):
                    shut = low.find("</" + name, shut + 2)
                end = len(page) if shut < 0 or shut > last else page.find(">", shut) + 1
                name = ""
            yield at, end, name, closing, attributes
        at = page.find("<", end)


def lines(page: str) -> list[Line]:
    """The page's lines, empty ones where a container's tag stood."""
    out: list[Line] = []
    held: list[str] = []
    linked = article = 0
    in_link = in_head = False
    skipping, depth = "", 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Line(text, max(0, len(text) - linked), article > 0))
        linked = 0

    def gap() -> None:
        end()
        out.append(_GAP)

    at = 0
    for start, stop, tag, closing, attributes in _tags(page):
        if start > at and not skipping and not in_head:
            piece = entities.unescape(page[at:start])
            held.append(piece)
            linked += len(piece) * in_link
        at = stop
        if not tag:
            continue
        opens = not closing and tag not in VOID and not attributes.endswith("/")
        if tag == "head" or in_head and (tag == "body" or not closing and (tag in CONTAINERS or tag in LINES)):
            in_head = tag == "head" and not closing
            if tag == "head":
                continue
        if skipping:
            if tag == skipping:
                depth += -1 if closing else opens
            if not depth or not closing and tag in ("article", "main") and not article or closing and tag in ("body", "article", "main"):
                skipping = ""
                if tag not in ("article", "main"):
                    continue
            else:
                continue
        if opens and _no_content(tag, attributes, article > 0):
            if tag in CONTAINERS or tag in LINES:
                end()
            skipping, depth = tag, 1
        elif tag in ("article", "main"):
            gap()
            article = max(0, article + (-1 if closing else 1))
        elif tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in CONTAINERS:
            gap()
        elif tag in LINES:
            end()
    if not skipping and not in_head:
        held.append(entities.unescape(page[at:]))
    end()
    return out


def stretches(counts: list[int], empty: list[bool], surge: int, dive: int, window: int) -> list[tuple[int, int]]:
    """(begin, end) of the lines between each surge of the window sums and the dive after it."""
    sums = [sum(counts[i : i + window]) for i in range(len(counts))]
    out, i, n = [], 0, len(counts)
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        # The line that carries the surge, back to the empty line or the line of links before it.
        begin = max(range(i, min(i + window, n)), key=lambda k: (counts[k], -k))
        while begin > i - window and begin > 0 and counts[begin - 1] and begin - 1 >= (out[-1][1] if out else 0):
            begin -= 1
        end = max(i, begin)
        while end < n and sums[end] > dive:
            end += 1
        while end < n and counts[end] and not empty[end]:
            end += 1
        out.append((begin, end))
        i = max(end, i + 1)
    return out


def chosen(page: list[Line], window: int | None = None, surge: int | None = None, dive: int | None = None) -> list[Line]:
    """The lines of the main text."""
    window, surge, dive = (WINDOW if window is None else window, SURGE_CHARS if surge is None else surge, DIVE_CHARS if dive is None else dive)
    empty = [not x.text for x in page]
    inside = any(x.article and x.text for x in page)
    if inside:
        counts = [x.count if x.article else 0 for x in page]
        if not any(counts):
            return [x for x in page if x.article and x.text]
        surge, dive = 1, 0
    else:
        counts = [x.count for x in page]
        if not any(counts):
            return []
        surge = min(surge, max(sum(counts[i : i + window]) for i in range(len(counts))))
        dive = min(dive, surge - 1)
    return [x for a, b in stretches(counts, empty, surge, dive, window) for x in page[a:b] if x.text and x.article >= inside]


def main_text(page: str) -> str:
    """The page's main text: its blocks joined by line ends."""
    return "\n".join(x.text for x in chosen(lines(page)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
