"""Operator 10: main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into blocks (paragraphs, headings, list items, cells, loose text of a container) in
page order. What is never main text is left out on the way: scripts, styles, forms, menus, headers, footers, sidebars, and elements whose
role, class or id names an advert, notice, menu, sidebar or reader comments and nothing else. A container whose class or id names a notice, menu or
sidebar is kept if it wraps the page's only articles, or at least SHARE of the text of a page that has none. Where such a name is only part
of a class or id beside words of another kind (social-history, related-work), the ratios decide: the container stays if the mean ratio of its text
is at least PART of the page's.

Each block has a ratio of its characters to its tags. Ratios are smoothed by a Gaussian over neighbouring blocks, and blocks at
or above a threshold (a share of the standard deviation over the page) form clusters of content. The clusters choose the region: the
lowest container of all `article` elements that hold some of their text, and of what else of it stands in `main`, or of the `main` elements;
on pages without either, the lowest container of all of it. All blocks of the region are kept, short ones between long ones too: the ratios select regions and
do not drop blocks inside one.

Text: character references decoded, white space inside a block one space (a line break is white space), blocks trimmed, empty ones left
out, joined by one line feed. Pages are parsed and cut in linear time, however deep their tags.

Defined results: null or empty html, and pages without main text, give the empty text and n_chars 0; unclosed and stray tags are
closed as browsers do by the next enclosing end, but a form, menu, header or the like that has no end tag of its own hides nothing; repeated rows give repeated rows; ties between containers go to the lowest that holds all; pages of any length are read whole; a null page_id
or url stays null; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIGMA = 2.0
THRESHOLD = 0.5
SHARE = 0.7
PART = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("head script style noscript template svg math iframe object canvas audio video nav header footer aside form button select option textarea label legend menu dialog title".split())
#: Of these, what hides nothing if it was never closed.
_LOOSE = frozenset("nav header footer aside form button select label legend menu dialog object audio video noscript".split())
_HEAD = frozenset("head title meta link script style base noscript template".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar comment comments commentlist respond replies disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login search pagination pager widget skip".split()
)
#: Of these names, what is never main text whatever it holds; the others also name wrappers of it.
_FIRM = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored cookie cookies consent gdpr comment comments commentlist respond replies disqus related recommended".split())
#: Words that say where or what kind of box a boilerplate class names.
_FILLER = frozenset("top bottom left right center box boxes container wrap wrapper block bar list item items site page global link links area section inner outer panel row col column main primary secondary mobile desktop sticky fixed small large unit slot zone region text title icon icons button buttons form post article content body js is hide hidden visible open the and of by my new".split())
#: Kinds of containers that are blocks themselves.
_LEAVES = frozenset("p li td th h1 h2 h3 h4 h5 h6 dt dd pre blockquote tr".split())
_KEPT = frozenset(("html", "body", "main", "article"))
_NEVER = frozenset(("with", "has", "no", "without"))
#: A start tag of the key ends open elements of the values.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_P = frozenset(("p",))
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Blocks(HTMLParser):
    """Blocks of a page: text, tags, and the container each stands in."""

    def __init__(self, loose: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.loose, self.seq, self.unclosed = loose, 0, set()  # elements by the number of their start tag: those that hide nothing, and those without an end
        self.open: list[tuple[str, int, bool, int]] = []  # tag, container, skipped, number
        self.count: Counter[str] = Counter()  # of open tags
        self.kind, self.parent, self.named = ["#"], [-1], [""]  # of the containers; named: "" no, "whole" or "part"
        self.blocks: list[tuple[str, int, int]] = []  # text, tags, container
        self.parts: list[str] = []
        self.tags = 0
        self.at = 0
        self.skip = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.tags, self.at))
                self.tags = 0
            self.parts = []

    def enter(self, tag: str, skipped: bool, named: str = "") -> None:
        self.open.append((tag, self.at, self.skip, self.seq))
        self.count[tag] += 1
        self.skip = self.skip or skipped
        if tag not in _INLINE:
            self.flush()
            self.kind.append(tag)
            self.parent.append(self.at)
            self.named.append(named)
            self.at = len(self.kind) - 1

    def leave(self, n: int, own: bool = False) -> None:
        """Close open[n] and all inside it; own: by its own end tag."""
        for tag, _, _, seq in self.open[n:]:
            self.count[tag] -= 1
            if tag in _LOOSE and not (own and seq == self.open[n][3]):
                self.unclosed.add(seq)
        if any(x[0] not in _INLINE for x in self.open[n:]):
            self.flush()
        _, self.at, self.skip, _ = self.open[n]
        del self.open[n:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            if tag == "hr":
                self.flush()
            return
        ends = _ENDS.get(tag) or (_P if tag in _BLOCK_ENDS_P else None)
        if ends and any(self.count[e] for e in ends):
            for n in range(len(self.open) - 1, -1, -1):
                if self.open[n][0] in ends:
                    self.leave(n)
                    break
                if self.open[n][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body"):
                    break
        if self.count["head"] and tag not in _HEAD:
            self.leave(next(n for n, x in enumerate(self.open) if x[0] == "head"), True)
        self.seq += 1
        skipped, named = tag in _SKIP and self.seq not in self.loose, ""
        if attrs and not skipped and tag not in _KEPT:
            skipped, named = _boilerplate(attrs)
            if tag in _INLINE or tag in _LEAVES:
                skipped, named = skipped or named == "whole", ""
        if tag in _INLINE and not skipped:
            return
        self.enter(tag, skipped, named)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.count[tag]:
            return
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] == tag:
                self.leave(n, True)
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)

    def unknown_decl(self, data: str) -> None:
        return


def _boilerplate(attrs: list[tuple[str, str | None]]) -> tuple[bool, str]:
    """Whether an element is never main text, and whether its class or id names it as what is not ("whole"), or holds such a name beside other words ("part")."""
    named = ""
    for name, value in attrs:
        if name == "hidden":
            return True, ""
        if not value:
            continue
        low = value.lower()
        if name == "role" and low in _ROLES or name == "aria-hidden" and low == "true":
            return True, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            return True, ""
        if name in ("class", "id"):
            for word in low.split():
                names = {x for x in _SPLIT.split(word) if x and not x.isdigit()}
                if names & _NAMES and not names & _NEVER:
                    if names - _NAMES - _FILLER:
                        named = named or "part"
                    elif names & _FIRM:
                        return True, ""
                    else:
                        named = "whole"
    return False, named


def parse(html: str) -> _Blocks:
    def fed(text: str, loose: frozenset[int] = frozenset()) -> _Blocks:
        p = _Blocks(loose)
        p.feed(text)
        p.close()
        if p.open:
            p.leave(0)
        p.flush()
        return p

    try:
        p = fed(html)
    except AssertionError:  # the parser refuses some declarations; they are no text
        html = html.replace("<![", "<!")
        p = fed(html)
    return fed(html, frozenset(p.unclosed)) if p.unclosed else p


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / weight


def main_text(html: str | None) -> str:
    p = parse(html or "")
    blocks = _unnamed(p)
    if not blocks:
        return ""
    content = _content(blocks)
    # text of content clusters in each container, its inner ones included
    held = [0.0] * len(p.kind)
    for (t, _, at), c in zip(blocks, content.tolist(), strict=True):
        held[at] += len(t) * c
    region = _region(p, _sums(p, held), held)
    keep = _inside(p, [c == region for c in range(len(held))])
    return "\n".join(t for t, _, at in blocks if keep[at])


def _content(blocks: list[tuple[str, int, int]]) -> np.ndarray:
    """Whether each block stands in a content cluster: its smoothed ratio of characters to tags reaches the threshold."""
    ratio = smoothed(np.array([len(t) for t, _, _ in blocks], dtype=np.float64) / np.array([max(1, n) for _, n, _ in blocks]))
    return ratio >= min(THRESHOLD * ratio.std(), ratio.max())


def _sums(p: _Blocks, own: list[float]) -> list[float]:
    """Own text of each container -> its text with that of inner ones."""
    held = list(own)
    for c in range(len(held) - 1, 0, -1):
        held[p.parent[c]] += held[c]
    return held


def _inside(p: _Blocks, marked: list[bool]) -> list[bool]:
    inside = list(marked)
    for c in range(1, len(inside)):  # parents come before their children
        inside[c] = inside[c] or inside[p.parent[c]]
    return inside


def _unnamed(p: _Blocks) -> list[tuple[str, int, int]]:
    """Blocks outside of named containers.

    A wholly named one that wraps the page's only articles, or on pages without any at least SHARE of the text, counts as unnamed; so does
    a partly named one whose ratio is at least PART of the page's.
    """
    if not any(p.named):
        return p.blocks
    own, rich = [0.0] * len(p.kind), [0.0] * len(p.kind)
    for t, n, at in p.blocks:
        own[at] += len(t)
        rich[at] += len(t) * len(t) / max(1, n)
    held, rich = _sums(p, own), _sums(p, rich)
    mean = rich[0] / max(1.0, held[0])  # of the ratios, by the text that has them
    named = [n == "whole" or n == "part" and rich[c] < PART * mean * held[c] for c, n in enumerate(p.named)]
    dropped = _inside(p, named)
    marks = [c for c in range(len(p.kind)) if p.kind[c] in ("article", "main") and held[c]]
    if marks and all(dropped[c] for c in marks):
        free = [False] * len(p.kind)
        for c in marks:
            while c > 0 and not free[c]:
                free[c] = True
                c = p.parent[c]
        free = [f and k not in ("article", "main") or f and not n for f, k, n in zip(free, p.kind, named, strict=True)]
        named = [n and not f for n, f in zip(named, free, strict=True)]
    elif not marks:
        named = [n and held[c] < SHARE * held[0] for c, n in enumerate(named)]
    dropped = _inside(p, named)
    return [b for b in p.blocks if not dropped[b[2]]]


def _common(p: _Blocks, containers: list[int]) -> int:
    """The lowest container that holds all of them; parents have smaller numbers."""
    at = sorted({-c for c in containers})  # a heap
    while True:
        low = -heapq.heappop(at)
        while at and at[0] == -low:
            heapq.heappop(at)
        if not at:
            return low
        heapq.heappush(at, -p.parent[low])


def _region(p: _Blocks, held: list[float], own: list[float]) -> int:
    within = _inside(p, [k == "article" for k in p.kind])
    articles = [c for c in range(1, len(p.kind)) if p.kind[c] == "article" and not within[p.parent[c]] and held[c]]
    mains = [c for c in range(1, len(p.kind)) if p.kind[c] == "main" and held[c]]
    if articles:
        in_main = _inside(p, [k == "main" for k in p.kind])
        beside = [c for c in range(len(p.kind)) if own[c] and in_main[c] and not within[c]]
        return _lifted(p, _common(p, articles + beside))
    if mains:
        return _lifted(p, _common(p, mains))
    return _lifted(p, _common(p, [c for c in range(len(p.kind)) if own[c]]))


def _lifted(p: _Blocks, c: int) -> int:
    """The nearest container that is not a block itself."""
    while p.kind[c] in _LEAVES:
        c = p.parent[c]
    return c


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
