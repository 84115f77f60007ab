"""Main text of web pages from the text-to-tag ratio of their lines.

The standard library's streaming parser turns a page into lines, one per block of text, side matter included, each with the
number of tags inside it, the share of it that is links, and what elements and class names say of it. The ratio of text to
tags, less the links, is weighed by those names (``MARKS``), smoothed by a Gaussian kernel and clustered by a threshold (its
standard deviation). The lines above it mark where the content lies: the innermost container with ``SHARE`` of their text that
leaves none of them directly around it, grown to its article. Lines of that region are kept whole, short ones too, but for lines of certain side matter, lines that
are mostly links outside an article, and lines of doubtful names that do not reach the threshold by themselves.

Certain side matter is that of elements made for it (menus, sidebars, forms, footers) and of class names such as comments or
adverts. Doubtful names (header, banner, share) count outside an article only, and not beside a name of content.

Defined results: a NULL or empty page, and one without any text, gives an empty text. Unclosed and truncated tags end with
their container or the page. The time follows the length of a page, however many elements stay open. Every row is handled by
itself, so repeated rows and ties do not matter; an empty table gives no rows. Other columns stay, but for one of the name of
the result, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from zephra.llm.catalog import query, table

# Element names of the HTML standard by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("canvas datalist embed head iframe map math noscript object option script select style svg template textarea title".split())
SIDE = set("aside button dialog fieldset footer form input label menu nav".split())
DROPPED = 3  # mark of what is not text of the page
BLOCKS = set(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr html li main nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = {"html", "body", "main", "article", "section", "div", "table", "tbody", "tr", "td"}
HOLDERS = {"article", "main"}
NEVER_BY_NAME = {"html", "body", "main"}
ENDS_PARAGRAPH = BLOCKS - {"html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main"}
# Words in class names and ids of side matter, and words that speak for content.
CERTAIN_WORDS = set(
    "ad ads advert adverts advertisement adsense sponsor sponsored sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs"
    " footer comment comments disqus replies cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login"
    " related recommended recommendations pagination pager".split()
)
DOUBTFUL_WORDS = set(
    "promo promotion banner header masthead reply respond notice notices overlay share sharing social widget toolbar skip".split()
)
CONTENT_WORDS = set("article post entry story content title headline lead".split())
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "note"}
_WORD = re.compile(r"[a-z0-9]+")
SIGMA = 1.0
SHARE = 0.7
MOSTLY = 0.5
PLAIN, DOUBTFUL, CERTAIN = 0, 1, 2
#: Weight of a line's ratio by its mark.
MARKS = [1.0, 0.25, 0.0]


class Line(NamedTuple):
    text: str
    tags: int
    links: float  # share of the text inside links
    mark: int
    container: int


class _Lines(HTMLParser):
    """Collects the lines of a page; containers have a number, and the number of the one around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # element, mark (or DROPPED), container or -1
        self.names: Counter[str] = Counter()  # open elements by name
        self.marks: Counter[int] = Counter()
        self.kinds: list[str] = [""]
        self.parents: list[int] = [0]
        self.around: list[int] = [0]
        self.lines: list[Line] = []
        self.pieces: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        whole = "".join(self.pieces)
        text = " ".join(whole.split())
        if text:
            mark = CERTAIN if self.marks[CERTAIN] else DOUBTFUL if self.marks[DOUBTFUL] else PLAIN
            self.lines.append(Line(text, self.tags, min(1.0, self.linked / len(text)), mark, self.around[-1]))
        self.pieces, self.tags, self.linked = [], 0, 0

    def pop_to(self, at: int) -> None:
        for name, mark, container in self.open[at:]:
            self.names[name] -= 1
            self.marks[mark] -= 1
            if container >= 0:
                self.around.pop()
        del self.open[at:]

    def close_open(self, names: set[str], scopes: set[str]) -> None:
        if not any(self.names[n] for n in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                self.pop_to(i)
                return
            if self.open[i][0] in scopes:
                return

    def mark_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        held = any(self.names[h] for h in HOLDERS)
        if tag in UNSEEN:
            return DROPPED
        if tag in SIDE or (tag == "header" and not held):
            return CERTAIN
        if tag in NEVER_BY_NAME:
            return PLAIN
        mark = PLAIN
        for name, value in attrs:
            if name in ("class", "id") and value:
                words = set(_WORD.findall(value.lower()))
                if words & CERTAIN_WORDS:
                    return CERTAIN
                if words & DOUBTFUL_WORDS and not words & CONTENT_WORDS and not held:
                    mark = DOUBTFUL
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return DROPPED
            if name == "role" and (value or "").lower() in SIDE_ROLES:
                return CERTAIN
        return mark

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag != "html":
                self.close_open({"head"}, set())
            if tag in ENDS_PARAGRAPH:
                self.close_open({"p"}, SCOPES | {"td", "li"})
            if tag in SIBLINGS:
                self.close_open(SIBLINGS[tag], SCOPES)
        if not self.marks[DROPPED]:
            self.tags += 1
            if tag == "br":
                self.pieces.append(" ")
        if tag in VOID:
            return
        mark = self.mark_of(tag, attrs)
        if mark != PLAIN:
            self.end_line()
        container = -1
        if tag in CONTAINERS:
            container = len(self.kinds)
            self.kinds.append(tag)
            self.parents.append(self.around[-1])
            self.around.append(container)
        self.open.append((tag, mark, container))
        self.names[tag] += 1
        self.marks[mark] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)
            if tag in BLOCKS or self.open[at][1] != PLAIN:
                self.end_line()
            self.pop_to(at)
        elif tag in BLOCKS:
            self.end_line()
        if not self.marks[DROPPED]:
            self.tags += 1

    def handle_data(self, data: str) -> None:
        if not self.marks[DROPPED]:
            self.pieces.append(data)
            if self.names["a"]:
                self.linked += len(data.strip())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian kernel of radius 2 sigma, renormalised at both ends."""
    radius = math.ceil(2 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        at = [(values[i + k], kernel[k + radius]) for k in range(-radius, radius + 1) if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in at) / sum(w for _, w in at))
    return out


def ratio(line: Line) -> float:
    """Text per tag, less its links, weighed by what its names say."""
    return len(line.text) / max(1, line.tags) * (1.0 - line.links) * MARKS[line.mark]


def content_lines(lines: list[Line]) -> tuple[list[bool], float]:
    """(whether the smoothed ratio of each line exceeds the threshold, the threshold)."""
    ratios = smoothed([ratio(x) for x in lines])
    mean = sum(ratios) / len(ratios)
    bar = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    found = [r > bar and x.mark != CERTAIN and x.links <= MOSTLY for r, x in zip(ratios, lines, strict=True)]
    return (found, bar) if any(found) else ([x.mark == PLAIN and x.links <= MOSTLY for x in lines], bar)


def region(page: _Lines, found: list[bool]) -> tuple[list[bool], bool]:
    """(whether each container lies in the content region, whether that is an article)."""
    mass = [0] * len(page.kinds)
    for x, good in zip(page.lines, found, strict=True):
        if good:
            mass[x.container] += len(x.text)
    own = list(mass)
    for c in range(len(mass) - 1, 0, -1):  # a container has a greater number than the one around it
        mass[page.parents[c]] += mass[c]
    best = 0
    for c in range(1, len(mass)):  # a container that has content of its own is not left for one inside it
        if page.parents[c] == best and not own[best] and mass[0] and mass[c] >= SHARE * mass[0]:
            best = c
    holder = best
    while holder and page.kinds[holder] not in HOLDERS:
        holder = page.parents[holder]
    best = holder or best
    inside = [False] * len(mass)
    for c in range(len(mass)):
        inside[c] = c == best or (c > 0 and inside[page.parents[c]])
    return inside, holder > 0


def main_text(html: str | None) -> str:
    """Text of the content region: blocks in page order, joined by one space."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    found, bar = content_lines(page.lines)
    inside, article = region(page, found)
    kept = []
    for x, good in zip(page.lines, found, strict=True):
        if not inside[x.container] or x.mark == CERTAIN:
            continue
        if x.mark == DOUBTFUL and not (good and ratio(x) > bar):
            continue
        if article or good or x.links <= MOSTLY:
            kept.append(x.text)
    return " ".join(kept)


@F.pandas_udf(StringType())
def _main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in pages:
        yield html.map(main_text)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in the column ``text``."""
    return pages.withColumn(text, _main_text(F.col(f"`{html}`")))


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
