"""Main text of web pages from parser events and text-to-tag ratios.

A page streams through the standard library's parser into lines, one for each block of text.
Each line's ratio of plain text to tags goes to a logarithmic scale; text in links does not
count as plain, and lists and tables have one ratio as a whole.  Elements and the words of
class, id and role are features of that ratio: they take it away (navigation, notices, forms,
reader comments) or raise it (article and main).  The ratios are smoothed by a Gaussian along
the page, each zone by itself, and clustered in two by a threshold; every line of the upper
cluster is content, whatever container it is in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
SILENT = frozenset("script style noscript template iframe object svg canvas math head title audio video map".split())
ASIDE = frozenset("nav footer aside form button select textarea input dialog menu fieldset label option datalist".split())
MAIN = frozenset(("article", "main"))
LISTS = frozenset(("ul", "ol", "dl", "table"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
IN_HEAD = frozenset("head title meta link script style base noscript template".split())
#: Words of furniture anywhere.
FURNITURE = re.compile(
    r"(^|[\s_-])(ad|ads|adv|advert\w*|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|discussion|disqus|donate|gdpr|"
    r"menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notification|overlay|pager|pagination|paywall|"
    r"popup|promo\w*|recommend\w*|related|replies|reply|respond|share|sharing|sidebar|side|signup|social|"
    r"sponsor\w*|subscribe|subscription|tags|toolbar|tracking|alert|disclaimer|widget|login|search|complementary|contentinfo|"
    r"alertdialog)($|[\s_-])",
    re.I,
)
#: Words of the page's edges, which are parts of an article inside one.
EDGES = re.compile(r"(^|[\s_-])(banner|foot|footer|head|header|masthead|topbar|site-?header|site-?footer)($|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: How many pieces of markup that never close are looked for the end of, and what skips the rest.
BROKEN = 8
TAG = re.compile("<[^<>]*>?")
#: A short line that starts so, after everything else, is the page's own notice.
OWNER = re.compile(r"(©|\(c\)|copyright\b|all rights reserved)", re.I)
#: Where a start tag closes an open element of the same name.
CLOSES = {
    "p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
#: Blocks that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol pre section table ul".split()
)

#: Plain characters a tag from which a line is content on any page, and what article and main add, as logarithms.
DENSE = float(np.log1p(2))
LIFT = 0.8
#: An element with more than this share of a page's text is a wrapper, whatever its class or form says.
WRAPPER = 0.8


@dataclass
class Line:
    """One block of text: plain characters are those outside links."""

    text: str
    plain: int
    tags: int
    links: int
    node: int
    heading: bool


class Page(HTMLParser):
    """Collects lines and the tree of open elements above them, each node by its parent's number.

    feed() may be called with pieces of a page.  Time and memory grow with the page, not with
    its depth: a line holds one number, and an end tag without a start is known by a count.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Of each node: parent, whether it is marked and wraps, is main, and its list.
        self.parent, self.marked, self.wraps, self.main, self.list = [0], [False], [False], [False], [0]
        self.stack: list[tuple[str, int, bool]] = []
        self.open: dict[str, int] = {}
        self.held: list[tuple[int, list[str], int]] = []
        self.words: list[str] = []
        self.plain = self.tags = self.links = 0
        self.link = -1

    def _top(self) -> tuple[str, int, bool]:
        return self.stack[-1] if self.stack else ("", 0, False)

    def _emit(self, node: int, words: list[str], plain: int, tag: str = "") -> None:
        text = " ".join("".join(words).split())
        if text:
            self.lines.append(Line(text, min(plain, len(text)), self.tags, self.links, node, tag in HEADINGS))
            self.tags = self.links = 0
        words.clear()

    def flush(self) -> None:
        """The text before a block begins or ends is a line; of pieces around marked inline elements, too."""
        for node, words, plain in self.held:
            self._emit(node, words, plain)
        self.held = [(node, words, 0) for node, words, _ in self.held]
        tag, node, _ = self._top()
        self._emit(node, self.words, self.plain, tag)
        self.plain = 0

    def _push(self, tag: str, marked: bool, wraps: bool) -> None:
        _, above, silent = self._top()
        number = len(self.parent)
        self.parent.append(above)
        self.marked.append(marked)
        self.wraps.append(wraps)
        self.main.append(tag in MAIN or self.main[above])
        self.list.append(number if tag in LISTS and not self.list[above] else self.list[above])
        self.stack.append((tag, number, silent or tag in SILENT))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        tag, node, _ = self.stack.pop()
        self.open[tag] -= 1
        if self.held and tag in INLINE:
            self._emit(node, self.words, self.plain)
            _, self.words, self.plain = self.held.pop()
            self.words.append(" ")
        if self.link > len(self.stack):
            self.link = -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.words.append(" ")
        if tag == "a":
            self.links += 1
            self.link = len(self.stack)
        inside = self.main[self._top()[1]]
        marked = self._marked(tag, attrs, inside)
        if tag in INLINE:
            if marked and tag not in VOID:
                self.held.append((self._top()[1], self.words, self.plain))
                self.words, self.plain = [], 0
                self._push(tag, True, False)
            return
        self.flush()
        if tag == "body" or tag not in IN_HEAD and self._top()[0] == "head":
            while self.stack and self.stack[-1][0] in IN_HEAD:
                self._pop()
        ends = CLOSES.get(tag, CLOSES["p"] if tag in ENDS_P else frozenset())
        while self.stack and self.stack[-1][0] in ends:
            self._pop()
        if tag not in VOID:
            element = tag in ASIDE or tag == "header" and not inside
            self._push(tag, (element or marked) and tag not in ("html", "body"), not element or tag in ("form", "fieldset"))

    @staticmethod
    def _marked(tag: str, attrs: list, inside: bool) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                if FURNITURE.search(value) or not inside and tag not in MAIN and tag not in HEADINGS and EDGES.search(value):
                    return True
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and HIDDEN.search(value):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link = -1
        if self.open.get(tag, 0):
            if tag not in INLINE:
                self.flush()
            while True:
                last = self.stack[-1][0]
                self._pop()
                if last == tag:
                    break
        elif tag not in INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self._top()[2]:
            self.words.append(data)
            if self.link < 0:
                self.plain += len(data.strip())

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known kind
            return self.parse_bogus_comment(i)

    def finish(self) -> list[Line]:
        """The lines of the whole page.

        What feed() left is a page's broken end: markup that never closes.  The parser would look
        for the end of each such piece again and again, so a few pieces are left out, and behind
        them tags are only skipped.
        """
        for _ in range(BROKEN):
            rest, self.rawdata = self.rawdata, ""
            if self.cdata_elem or rest.startswith("<!--"):
                break
            if not re.match("<[a-zA-Z/!?]", rest):
                self.handle_data(unescape(rest))
                break
            cut = rest.find("<", 1)
            if cut < 0:
                break
            self.feed(rest[cut:])
        else:
            self.handle_data(unescape(TAG.sub(" ", self.rawdata)))
            self.rawdata = ""
        while self.held:
            self._pop()
        self.flush()
        return self.lines

    def zones(self) -> np.ndarray:
        """For each line 0, or 1 in an article or main, or 2 in furniture and the like.

        A marked element is a wrapper, and no furniture, if it holds every article and main of
        the page and half of its text, or if it may wrap and has nearly all of the text.
        """
        n = len(self.parent)
        size, lines, mains = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for line in self.lines:
            size[line.node] += len(line.text)
            lines[line.node] += 1
        for k in range(1, n):
            if self.main[k] and not self.main[self.parent[k]] and not self.marked[k]:
                mains[k] = 1
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            size[up] += size[k]
            lines[up] += lines[k]
            mains[up] += mains[k]
        zone = np.zeros(n, np.int8)
        for k in range(1, n):
            wrapper = mains[k] == mains[0] and (
                mains[k] > 0 and size[k] > size[0] / 2 or self.wraps[k] and lines[k] > 2 and size[k] > WRAPPER * size[0]
            )
            above = zone[self.parent[k]]
            zone[k] = 2 if above == 2 or self.marked[k] and not wrapper else 1 if self.main[k] else 0
        return zone[[line.node for line in self.lines]]


def smooth(values: np.ndarray, zones: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average of each line over the lines of its own zone, by their distance on the page."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    along = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    out = np.zeros(len(values))
    for zone in np.unique(zones):
        own = zones == zone
        out[own] = along(np.where(own, values, 0.0))[own] / along(own.astype(float))[own]
    return out


def threshold(values: np.ndarray) -> float:
    """The cut half-way between the means of two clusters, from the mean on, until it stands still.

    It is at most DENSE, and 0 if the lower cluster's mean is over half of the upper one's: then
    all is of one kind.
    """
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            return 0.0
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return 0.0 if 2 * low.mean() > high.mean() else min(cut, DENSE)


def ratios(page: Page, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithmic text-to-tag ratio of each line with its features, the group it is decided with, and zones.

    The lines of a list or table make a group with one ratio of plain text to links; other
    lines stand alone.  Outside article and main a ratio is weighted by the share of text there,
    and groups of several links with little else are a zone of their own, 3.
    """
    lines, n = page.lines, len(page.lines)
    kind = np.array([page.list[x.node] for x in lines])
    _, group = np.unique(np.where(kind > 0, kind, -1 - np.arange(n)), return_inverse=True)
    plain, links = (np.bincount(group, [getattr(x, a) for x in lines])[group] for a in ("plain", "links"))
    alone = np.array([x.plain / max(1, x.tags) for x in lines])
    value = np.log1p(np.where(kind > 0, plain / (2 + links), alone))
    text = np.array([len(x.text) for x in lines], float)
    share = text[zones == 1].sum() / max(1.0, text[zones < 2].sum())
    value = np.where(zones == 1, value + LIFT, np.where(zones == 0, value * (1 - share), 0.0))
    for k in range(n - 2, -1, -1):
        if lines[k].heading and zones[k] == zones[k + 1]:
            value[k] = max(value[k], value[k + 1])
    if zones[-1] == 0 and n > 1 and text[-1] < 200 and OWNER.match(lines[-1].text):
        value[-1], zones[-1] = 0.0, 2
    menu = (zones == 0) & (links > 1) & (4 * plain < np.bincount(group, text)[group])
    return value, group, np.where(menu, 3, zones)


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The lines of the upper cluster joined by newlines; empty for null, empty or wordless pages.

    A line whose smoothed ratio is just the cut is kept.
    """
    page = Page()
    page.feed(html or "")
    lines = page.finish()
    if not lines:
        return ""
    value, group, zones = ratios(page, page.zones())
    smoothed = smooth(value, zones, sigma)
    best = np.zeros(int(group.max()) + 1)
    np.maximum.at(best, group, smoothed)
    cut = threshold(smoothed)
    kept = (best[group] >= cut) & (best[group] > 0)
    return "\n".join(x.text for x, k in zip(lines, kept.tolist()) if k)


def _extract(batches: Iterator[pa.RecordBatch], sigma: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html"):
            texts = [main_text(x, sigma) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("page_id", "url")), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of pages.

    pages needs page_id, url and html; other columns are ignored, whatever their names.  Null,
    empty or wordless html gives an empty text; ids and urls pass as they are, repeated or null,
    and repeated rows give repeated results.  Lines at the cut are kept.  A page may be of any
    length and depth.  An empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return pages.mapInArrow(lambda it: _extract(it, sigma), "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, by :func:`extract` with its defaults, which says what nulls, empties, ties and repeats give."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
