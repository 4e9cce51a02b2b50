"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

The standard library's parser streams events; block-level tags cut the page into lines. A line's ratio
is its text outside links by its tags; elements that are marked as menus, notices, forms and the like
count no text, as long as the page's text is elsewhere. A Gaussian smooths the ratios over neighbouring
lines, and lines above a threshold, a share of the ratios' standard deviation, cluster as content.

The clustered lines select the region: article (else main) elements that hold a good part of them,
otherwise the innermost element that holds them all and the main headings, grown while ancestors add
headings alone. The page's text is the region's clustered lines, and those of its lines, however
short, that are neither marked nor lists of links in which nothing clusters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start and end begin a new line.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content isn't text of the page.
_SILENT = frozenset("applet audio canvas datalist head iframe math noscript object script select style svg template textarea title video".split())
#: Elements marked by what they are.
_MARKED = frozenset("aside button dialog footer form menu nav search".split())
#: Words of class, id or role that mark what isn't main text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side rail nav"
    " navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup login social share sharing comment comments reply replies"
    " respond disqus related recommended recommendations widget toolbar pagination pager contentinfo complementary search"
    " disclaimer copyright".split()
)
#: A name that begins or ends so tells of a page or its layout (has-sidebar, search-page).
_ABOUT = (frozenset("has is no not with without".split()), frozenset("article body content entry layout main page post".split()))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNMARKED = frozenset("html body main".split())
_LISTS = frozenset("dl menu ol table ul".split())
#: An element of a kind ends that of the same kind before it, inside the same parent.
_ENDS = {"li": 0, "dd": 1, "dt": 1, "option": 2, "tr": 3, "td": 4, "th": 4}
_SCOPE = frozenset("article aside body dl footer form header html main menu nav ol section select table td th ul".split())
_NONE = (-1,) * 5
_WORDS = re.compile(r"[a-z]+")


def _names_boilerplate(value: str) -> bool:
    """Whether a class, id or role holds a name of what isn't main text."""
    for name in value.lower().split():
        parts = _WORDS.findall(name)
        if not _NAMES.isdisjoint(parts) and parts[0] not in _ABOUT[0] and parts[-1] not in _ABOUT[1]:
            return True
    return False


class Page(HTMLParser):
    """The page's elements and lines, in one pass: time and memory grow with the page alone, however deep it nests.

    Elements are numbered as they begin, so that those inside one follow it without a gap. Numbered are
    blocks and marked elements; others belong to the one around them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags = [""]
        self.parents = [-1]
        self.marked = [False]
        #: (text, letters in links, tags, element)
        self.lines: list[tuple[str, int, int, int]] = []
        self._open: list[tuple[str, int, int, tuple[int, ...], int]] = []  # tag, element, whether silent, what it may end, paragraph
        self._count: Counter = Counter()  # open elements by tag
        self._silent = self._links = self._seen = self._articles = 0
        self._text: list[tuple[int, bool, str]] = []

    def handle_starttag(self, tag, attrs):
        self._seen += 1
        block = tag in _BLOCK
        if block:
            self._end_line()
            if self._open and self._open[-1][4] >= 0:
                self._pop(self._open[-1][4])
            if tag not in ("title", "html", "head") and self._count["head"]:
                self._close("head")
            if tag in _ENDS and self._open and (at := self._open[-1][3][_ENDS[tag]]) >= 0:
                self._pop(at)
        if tag == "br":
            self._say(" ")
        if tag in _VOID:
            return
        if tag == "a":
            self._links += 1
        silent = tag in _SILENT or any(name == "hidden" for name, _ in attrs)
        marked = tag in _MARKED or tag == "header" and not self._articles
        if not marked and tag not in _UNMARKED:
            marked = any(value and name in ("class", "id", "role") and _names_boilerplate(value) for name, value in attrs)
        if block or silent or marked:
            at = len(self._open)
            ends, paragraph = (self._open[-1][3], self._open[-1][4]) if self._open else (_NONE, -1)
            if tag in _SCOPE:
                ends = _NONE
            if tag in _ENDS:
                ends = tuple(at if k == _ENDS[tag] else -1 if k > _ENDS[tag] >= 3 else x for k, x in enumerate(ends))
            if block:
                paragraph = at if tag == "p" else -1
            self.parents.append(self._open[-1][1] if self._open else 0)
            self._open.append((tag, len(self.tags), silent, ends, paragraph))
            self.tags.append(tag)
            self.marked.append(marked)
            self._count[tag] += 1
            self._silent += silent
            self._articles += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._seen += 1
        if tag in _BLOCK:
            self._end_line()
        if tag == "a":
            self._links = max(0, self._links - 1)
        self._close(tag)

    def handle_data(self, data):
        self._say(data)

    def finish(self) -> list[tuple[str, int, int, int]]:
        self.close()
        self._end_line()
        return self.lines

    def _say(self, data):
        if not self._silent:
            self._text.append((self._open[-1][1] if self._open else 0, self._links > 0, data))

    def _close(self, tag):
        if self._count[tag]:
            k = len(self._open) - 1
            while self._open[k][0] != tag:
                k -= 1
            self._pop(k)

    def _pop(self, k):
        for tag, _, silent, _, _ in self._open[k:]:
            self._count[tag] -= 1
            self._silent -= silent
            self._articles -= tag in ("article", "main")
        del self._open[k:]

    def _end_line(self):
        if not self._text:
            return
        self._links = 0  # a link that a block ends was left open
        # A marked element inside a block has a line of its own and doesn't cut the block's.
        parts: dict[int, list[tuple[bool, str]]] = {}
        for element, link, data in self._text:
            parts.setdefault(element, []).append((link, data))
        self._text.clear()
        for element, pieces in parts.items():
            text = " ".join("".join(data for _, data in pieces).split())
            if text:
                linked = sum(len(" ".join(data.split())) for link, data in pieces if link)
                self.lines.append((text, min(linked, len(text)), self._seen, element))
                self._seen = 0


def smooth(ratios: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; at the ends the weights that remain are scaled up."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        a, b = max(0, i - radius), min(len(ratios), i + radius + 1)
        weights = kernel[a - i + radius : b - i + radius]
        out.append(sum(w * r for w, r in zip(weights, ratios[a:b])) / sum(weights))
    return out


def _clustered(ratios: list[float], sigma: float, threshold: float) -> tuple[list[bool], float]:
    """Which lines' smoothed ratios exceed the threshold, and that threshold."""
    smoothed = smooth(ratios, sigma)
    mean = sum(smoothed) / len(smoothed)
    least = threshold * math.sqrt(sum((r - mean) ** 2 for r in smoothed) / len(smoothed))
    return [r > least for r in smoothed], least


def _below(values: list[float], parents: list[int]) -> list[float]:
    """Of each element, the sum over all inside it; elements follow their parents."""
    out = list(values)
    for e in range(len(out) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def _inherited(own: list[bool], parents: list[int]) -> list[bool]:
    """Whether an element or one around it has the mark."""
    out = list(own)
    for e in range(1, len(out)):
        out[e] = out[e] or out[parents[e]]
    return out


def _marks(page: Page, lines: list, sigma: float, threshold: float) -> list[bool]:
    """Which lines lie in marked elements; a mark on what holds the page's text doesn't count.

    That is a marked element with half of the text that clusters by the plain ratios, if none of
    article, main and main heading is without a mark, and it has one inside or, marked by name, two
    paragraphs while little text is without a mark.
    """
    tags, parents, marked = page.tags, page.parents, page.marked
    inside = _inherited(marked, parents)
    cluster, _ = _clustered([(len(t) - linked) / max(1, n) for t, linked, n, _ in lines], sigma, threshold)
    text, plain = [0.0] * len(tags), 0.0
    for (t, linked, _, e), c in zip(lines, cluster):
        if c:
            text[e] += len(t) - linked
            plain += 0 if inside[e] else len(t) - linked
    text = _below(text, parents)
    heads = [float(tag in ("article", "main", "h1") and not m) for tag, m in zip(tags, marked)]
    free_heads = sum(h for h, m in zip(heads, inside) if not m)
    heads = _below([h or float(tag in ("article", "main")) for h, tag in zip(heads, tags)], parents)
    paragraphs = _below([float(tag == "p") for tag in tags], parents)
    true = list(marked)
    for e, m in enumerate(marked):
        if m and not free_heads and text[e] >= text[0] / 2 > 0:
            true[e] = not (heads[e] or tags[e] not in _MARKED and paragraphs[e] > 1 and plain < text[e] / 4)
    inside = _inherited(true, parents)
    return [inside[e] for _, _, _, e in lines]


def main_text(html: str | None, *, sigma: float = 1.0, threshold: float = 0.5, part: float = 0.3) -> str:
    """The main text: blocks in page order, one line each; empty for null, empty or textless pages.

    Linear in the page's size, also where elements nest deeply or are never closed.
    """
    if not html:
        return ""
    page = Page()
    page.feed(html)
    lines = page.finish()
    if not lines:
        return ""
    tags, parents = page.tags, page.parents
    out = _marks(page, lines, sigma, threshold)
    ratios = [0.0 if o else (len(t) - linked) / max(1, n) for (t, linked, n, _), o in zip(lines, out)]
    content, least = _clustered(ratios, sigma, threshold)
    links = [2 * linked > len(t) for t, linked, _, _ in lines]
    # What smoothing lends to a marked line, or one of links, beside a paragraph isn't its own.
    content = [c and (r > least or not (o or x)) for c, o, x, r in zip(content, out, links, ratios)]
    if not any(content):
        content = [not o for o in out]
        if not any(content):
            return ""

    def within(kept: list[bool], amount=lambda line: 1.0) -> list[float]:
        own = [0.0] * len(tags)
        for line, k in zip(lines, kept):
            if k:
                own[line[3]] += amount(line)
        return _below(own, parents)

    chars = within(content, lambda line: len(line[0]))
    clustered = within(content)
    region = None
    for tag in ("article", "main"):
        own = _inherited([t == tag for t in tags], parents)
        if sum(len(line[0]) for line, c in zip(lines, content) if c and own[line[3]]) >= part * chars[0]:
            region = [own[line[3]] for line in lines]
            break
    if region is None:
        region = _innermost(page, lines, content, out)
    # A list in which only links are and nothing clusters is a menu.
    others = within([not x and not o for x, o in zip(links, out)])
    items = within([True] * len(lines))
    menu = _inherited([t in _LISTS and not clustered[e] and not others[e] and items[e] > 1 for e, t in enumerate(tags)], parents)
    return "\n".join(line[0] for line, r, c, o in zip(lines, region, content, out) if r and (c or not o and not menu[line[3]]))


def _innermost(page: Page, lines: list, content: list[bool], out: list[bool]) -> list[bool]:
    """The lines in the innermost element of all clustered lines and main headings, grown by headings alone."""
    tags, parents = page.tags, page.parents
    title = _inherited([t == "h1" for t in tags], parents)
    heading = _inherited([t in _HEADINGS for t in tags], parents)
    inside = [line[3] for line, c, o in zip(lines, content, out) if c or not o and title[line[3]]]
    last = list(range(len(tags)))
    for e in range(len(tags) - 1, 0, -1):
        last[parents[e]] = max(last[parents[e]], last[e])
    region, high = min(inside), max(inside)
    while last[region] < high:
        region = parents[region]
    plain = [0.0] * len(tags)
    for line, o in zip(lines, out):
        plain[line[3]] += not o and not heading[line[3]]
    plain = _below(plain, parents)
    while region > 0 and plain[parents[region]] == plain[region]:
        region = parents[region]
    return [region <= line[3] <= last[region] for line in lines]


def extract_text(pages: DataFrame, *, keep: Iterable[str] = ("page_id", "url"), html: str = "html", name: str = "text") -> DataFrame:
    """The columns ``keep`` of every page and its main text, from the whole html.

    Null and empty html give an empty text, as does a page without text; long and deep pages are read
    whole. Repeated rows are read each, an empty table gives none; other columns aren't read.
    """
    return map_texts(pages, list(keep), [(name, "string")], lambda: lambda texts: [[main_text(t) for t in texts]], html)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from pyspark.sql import functions as F

    from .common import read

    return extract_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
