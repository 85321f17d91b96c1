"""Main text of web pages from parser events and text-to-tag ratios.

The events of the standard library's parser cut a page into blocks, one line each: a block tag starts a new
line, inline tags only count. The ratio of a line is its text over its tags. Ratios are smoothed with a
Gaussian along the page, and lines above the threshold (the mean ratio less ``SPREAD`` standard deviations
of the page, at least ``LEAST``) form clusters. The heaviest cluster shows which element is the content: the
article or main element around it, else the smallest element that holds most of the text of all clusters.
All lines of that element are the text, short ones as well, but for boilerplate: elements that are by their
tag, role, class or id navigation, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, styles or reader comments.

Texts are whole: nothing is cut or capped. The parser is fed one page at a time and a page is the unit of
work; no data moves between tasks.

Cases: null and empty html give an empty text; unclosed and stray tags are tolerated; a page without an
element around its text is taken as a whole; repeated pages give repeated results; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 2.0
SPREAD = 0.5
LEAST = 10.0

# fixed values: elements of the HTML standard by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
HIDDEN = frozenset(
    "script style head title noscript template svg math iframe object canvas select option textarea audio video map datalist".split()
)
BOILERPLATE = frozenset("nav footer aside form button menu dialog fieldset input label search".split())
CONTENT = frozenset(["article", "main"])
# fixed values: words in roles, classes and ids
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside banner "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent "
    "notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended comment comments respond discussion disqus widget toolbar pagination pager search "
    "copyright legal complementary contentinfo dialog skip toc tags".split()
)
CONTENT_WORDS = frozenset("article main content post entry story".split())
# an element that opens closes these that are still open
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
split_words = re.compile(r"[a-z]+|[A-Z][a-z]*").findall


class Element:
    __slots__ = ("tag", "parent", "boilerplate", "content", "depth")

    def __init__(self, tag: str, parent: "Element | None", boilerplate: bool, content: bool):
        self.tag, self.parent, self.boilerplate, self.content = tag, parent, boilerplate, content
        self.depth = parent.depth + 1 if parent else 0

    def within(self, other: "Element") -> bool:
        e = self
        while e.depth > other.depth:
            e = e.parent
        return e is other


class Lines(HTMLParser):
    """Collects (element, text, number of tags) of each line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", None, False, False)
        self.at = self.root
        self.lines: list[tuple[Element, str, int]] = []
        self.text: list[str] = []
        self.tags = 0
        self.hidden = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((self.at, text, self.tags))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.open(tag, attrs)
            self.hidden += 1
            return
        if self.hidden:
            if tag not in VOID:
                self.open(tag, attrs)
            return
        self.tags += 1
        if tag == "br":
            self.text.append("\n")  # white space inside a block
            return
        if tag in INLINE:
            if tag not in VOID and marked(tag, attrs)[0]:
                self.end_line()  # an inline advert is a line of its own
                self.open(tag, attrs)
            return
        self.end_line()
        if tag in VOID:
            return
        if tag in CLOSE_P:
            self.close_open({"p"}, CLOSE_P - {"p"})
        if tag in CLOSES:
            self.close_open(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        self.open(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN and not self.hidden:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        e = self.at
        while e is not self.root and e.tag != tag:
            e = e.parent
        if self.hidden:
            if e is not self.root:
                self.leave(e)
            return
        self.tags += 1
        if e is self.root and tag in INLINE:
            return
        self.end_line()
        if e is not self.root:
            self.leave(e)

    def open(self, tag, attrs):
        boilerplate, content = marked(tag, attrs)
        inside = any(p.content for p in self.ancestors())
        if tag == "header" and not inside:
            boilerplate = True
        self.at = Element(tag, self.at, boilerplate or self.at.boilerplate or tag in HIDDEN, content)

    def ancestors(self):
        e = self.at
        while e is not None:
            yield e
            e = e.parent

    def close_open(self, tags, stop):
        e = self.at
        while e is not self.root and e.tag not in tags and e.tag not in stop:
            e = e.parent
        if e.tag in tags:
            self.leave(e)

    def leave(self, e):
        while self.at is not e.parent:
            self.hidden -= self.at.tag in HIDDEN
            self.at = self.at.parent

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def close(self):
        super().close()
        self.end_line()


def marked(tag: str, attrs) -> tuple[bool, bool]:
    """Is an element boilerplate, is it content, by its tag and attributes?"""
    boilerplate, content = tag in BOILERPLATE, tag in CONTENT
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            own = {w.lower() for w in split_words(value)}
            content |= not CONTENT_WORDS.isdisjoint(own)
            if not BOILERPLATE_WORDS.isdisjoint(own) and tag not in ("html", "body", "article", "main"):
                boilerplate = True
        elif name in ("hidden",) or name == "aria-hidden" and value == "true":
            boilerplate = True
        elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            boilerplate = True
    return boilerplate, content and not boilerplate


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that are left add up to one."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA**2))
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def content_element(lines: list[tuple[Element, str, int]]) -> Element:
    """The element that the clusters of high text-to-tag ratio point at."""
    weight = np.array([0 if e.boilerplate else len(t) for e, t, _ in lines], dtype=float)
    ratio = smooth(weight / np.array([max(1, n) for _, _, n in lines]))
    high = (ratio >= max(LEAST, ratio.mean() - SPREAD * ratio.std())) & (weight > 0)
    if not high.any():
        high = weight > 0
    cluster = np.cumsum(np.diff(high, prepend=False) & high) * high
    heaviest = int(np.bincount(cluster, weight * high)[1:].argmax()) + 1
    inside = np.flatnonzero(cluster == heaviest)
    e = lines[inside[int(weight[inside].argmax())]][0]
    named, up = None, e
    while up is not None:
        if up.content and (named is None or up.tag in CONTENT and named.tag not in CONTENT):
            named = up
        up = up.parent
    if named is not None:
        return named
    total = (weight * high).sum()
    while e.parent is not None:
        held = sum(w for w, h, line in zip(weight, high, lines) if h and line[0].within(e))
        if held >= 0.9 * total:
            break
        e = e.parent
    return e


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not any(not e.boilerplate for e, _, _ in lines):
        return ""
    around = content_element(lines)
    return "\n\n".join(t for e, t, _ in lines if not e.boilerplate and e.within(around))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""

    def run(batches):
        for b in batches:
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
