"""Main text of web pages by tag-path ratios.

A page is read into blocks, each with the path of tags from the root to it; inline tags belong to their block. Blocks
of one path look alike in a layout, so the path is judged, not the block: text length, punctuation and linked text are
summed per path and divided by its number of blocks. The ratios are smoothed over the page order with a Gaussian, fused
into one score, and paths that stay above a threshold from the spread of the scores carry the content. A short
paragraph is kept with the path of the long ones. What page authors mark as something else (menus, headers, footers,
sidebars, notices, adverts, forms, comments, hidden parts) is left out before paths are judged; a name that has other
words in it as well, such as social-history, counts only if the text agrees: mostly linked, or without punctuation. The
element that holds the content is then taken: its blocks on chosen paths, but for those that are mostly linked text
themselves; its lists, tables, quotations and figures whose linked text is at most half of their text, each as a whole;
and its headings, but for one that mostly linked text follows.

Defined results: a null or empty page, or one without text, has an empty text; broken markup is read as far as it
goes; repeated rows are extracted each on its own. White space inside a block becomes one space, blocks are joined by
one line feed, nothing is cut. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deltawarden.llm.common import whole_text

# Tags by their role in a page, and words in class, id and role attributes that mark a part as no content.
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset((
    "applet audio button canvas datalist embed head iframe input math noembed noframes noscript object option progress "
    "script select style svg template textarea title video").split())
ASIDE = frozenset("aside dialog footer menu nav".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
END_TAG = re.compile(r"</([a-z]+)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNITS = frozenset("blockquote dir dl figure menu ol pre table ul".split())
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_INSIDE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
               "th": {"table"}}
COMMENTS = frozenset("comment comments commentlist commentary disqus discussion replies responses respond".split())
MARKED = COMMENTS | frozenset((
    "ad ads advert adverts advertisement advertising adsense adbox adslot alert announcement banner breadcrumb "
    "breadcrumbs captcha consent cookie cookies copyright dfp disclaimer footer gdpr hidden login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo "
    "promotion promoted recommendations recommended related share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets").split())
# What stands beside a marked word without changing what the part is; other words make the mark a weak one.
BESIDE = frozenset((
    "a area article articles bar block body bottom box btn button col column container content desktop div fixed global group "
    "header in inline inner item items js left line link links list m main mobile more news nested outer page panel post "
    "posts primary right row secondary section site small sticky sub text the title top ul unit widget wrap wrapper xl xs"
    ).split())
ROLES = frozenset((
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar").split())
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True)
class PathRules:
    """spread: width of the Gaussian in blocks. threshold: a path's score must reach this share of the deviation of
    all scores. linked: the most linked text, as a share, of what stays without its path being chosen."""

    spread: float = 1.0
    threshold: float = 0.6
    linked: float = 0.5


@dataclass
class Element:
    tag: str
    parent: int
    path: int  # number of the path of block tags from the root
    container: int  # the nearest block element, itself included
    mark: str = ""  # why it is no content: "tag", "wrap" (a form or hidden), "name", "weak", "comment", "header"
    own: bool = False  # whether the mark is its own and not that of an element around it
    main: bool = False
    holds_main: bool = False  # an article, the main part or the first heading
    holds_top: bool = False  # the main part or the first heading; comments can be articles, too
    text: int = 0
    linked: int = 0
    stops: int = 0  # punctuation marks


@dataclass
class Block:
    element: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    stops: int = 0


class PageReader(HTMLParser):
    """Elements and text blocks of a page, in page order."""

    def __init__(self, html: str = ""):
        super().__init__(convert_charrefs=True)
        # End tags to come: a silent element that none of them can close holds nothing.
        self.ends = Counter(END_TAG.findall(html.lower()))
        self.elements = [Element("#root", -1, 0, 0)]
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [0]
        self.silent: list[str] = []
        self.links = 0
        self.blocks: list[Block] = []
        self.current: Block | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent == ["head"] and tag not in IN_HEAD and tag != "head":
            self.silent.clear()  # a head ends before the first tag that cannot stand in it
        if self.silent:
            if tag not in VOID and (tag not in SILENT or self.ends[tag] > 0):
                self.silent.append(tag)
            return
        if tag in SILENT:
            if tag not in VOID and (tag == "head" or self.ends[tag] > 0):
                self.silent.append(tag)
            return
        if tag in VOID:
            self._break(hard=tag == "hr")
            return
        block = tag in BLOCKS
        if block:
            self._close_implied(tag)
            self.current = None
        if tag == "a":
            self.links += 1
        parent = self.stack[-1]
        above = self.elements[parent]
        path = self.paths.setdefault((above.path, tag), len(self.paths) + 1) if block else above.path
        element = Element(tag, parent, path, len(self.elements) if block else above.container, above.mark, main=above.main)
        if element.mark in ("", "wrap", "weak") or attrs:
            self._mark(element, dict(attrs))
        if element.tag in ("article", "main") or tag == "h1":
            above.holds_main, above.holds_top = True, above.holds_top or element.tag != "article"
        self.elements.append(element)
        self.stack.append(len(self.elements) - 1)

    def _mark(self, element: Element, attrs: dict[str, str | None]) -> None:
        tag = element.tag
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        tokens = [{p.lower() for p in NAME_PARTS.findall(name)} for name in names.split()]
        parts = set().union(*tokens)
        if element.mark != "comment" and parts & COMMENTS and tag not in ("body", "html"):
            element.mark, element.own = "comment", True
        if element.mark not in ("", "wrap", "weak"):
            return
        role, own = (attrs.get("role") or "").lower(), ""
        if tag in ASIDE or role in ROLES and role != "form":
            own = "tag"
        elif tag == "form" or role == "form" or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (
                NOT_SHOWN.search(attrs.get("style") or "")):
            own = "wrap"
        elif parts & MARKED and tag not in ("body", "html", "main"):
            # A token of marked words, such as cookie-notice, or one that has another word, such as social-history.
            own = "name" if any(t & MARKED and t <= MARKED | BESIDE for t in tokens) else "weak"
        elif tag == "header":
            own = "header"  # of the page, or of an article: then its headings count
        if own:
            element.mark, element.own = own, True
        if tag in ("article", "main") or attrs.get("itemprop") == "articleBody" or attrs.get("role") == "main":
            element.main = True

    def _close_implied(self, tag: str) -> None:
        """A new block ends an open paragraph; a new list item or cell ends the one before it."""
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.elements[self.stack[depth]].tag
            if name == "p" or name in HEADINGS and tag in HEADINGS:
                self._pop(depth)
                break
            if name in BLOCKS:
                break
        ends, inside = ENDS_BEFORE.get(tag), ENDS_INSIDE.get(tag)
        if ends:
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.elements[self.stack[depth]].tag
                if name in inside:
                    break
                if name in ends:
                    self._pop(depth)
                    if tag != "tr":
                        break

    def _pop(self, depth: int) -> None:
        for at in self.stack[depth:]:
            if self.elements[at].tag == "a":
                self.links -= 1
            if self.elements[at].container == at:
                self.current = None
        del self.stack[depth:]

    def handle_endtag(self, tag: str) -> None:
        self.ends[tag] -= 1
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag):]
                return
            if not any(self.elements[at].tag == tag for at in self.stack[1:]):
                return
            self.silent.clear()  # the end of an element around ends what was left open inside
        if tag == "br":
            self._break(hard=False)
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.elements[self.stack[depth]].tag
            if name == tag:
                self._pop(depth)
                return
            if name in ("td", "th", "li", "article", "main") and tag not in BLOCKS:
                return  # an inline end tag does not reach out of its cell

    def handle_data(self, data: str) -> None:
        if self.silent == ["head"] and data.strip():
            self.silent.clear()
        if self.silent:
            return
        if self.current is None:
            if not data.strip():
                return
            at = self.elements[self.stack[-1]].container
            # Inline parts with a mark of their own, such as a hidden span, are blocks of their own.
            self.current = Block(at)
            self.blocks.append(self.current)
        at = self.stack[-1]
        while at > self.current.element:
            if self.elements[at].own:
                return
            at = self.elements[at].parent
        self.current.parts.append(data)
        if self.links:
            self.current.linked += len(data)

    def _break(self, hard: bool) -> None:
        if hard:
            self.current = None
        elif self.current is not None:
            self.current.parts.append(" ")


def _under(elements: list[Element], root: int) -> list[bool]:
    """For every element whether it is the root or stands under it. Parents come before their children."""
    found = [False] * len(elements)
    for at in range(root, len(elements)):
        found[at] = at == root or elements[at].parent >= root and found[elements[at].parent]
    return found


def smoothed(values: np.ndarray, spread: float) -> np.ndarray:
    """Gaussian over neighbours in page order; the ends are weighed by what is there."""
    radius = max(1, math.ceil(2 * spread))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / spread) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[radius:len(values) + radius]
    return np.convolve(values, kernel)[radius:len(values) + radius] / weight


def content_paths(blocks: list[Block], elements: list[Element], rules: PathRules) -> set[int]:
    """The paths whose fused, smoothed ratios reach the threshold."""
    paths: dict[int, list[float]] = {}
    for b in blocks:
        sums = paths.setdefault(elements[b.element].path, [0.0, 0.0, 0.0, 0.0])
        sums[0] += 1
        sums[1] += len(b.text)
        sums[2] += b.stops
        sums[3] += min(b.linked, len(b.text))
    of_block = [paths[elements[b.element].path] for b in blocks]
    lengths = smoothed(np.array([s[1] / s[0] for s in of_block]), rules.spread)
    marks = smoothed(np.array([s[2] / s[0] for s in of_block]), rules.spread)
    free = np.array([1 - s[3] / s[1] for s in of_block])
    fused = lengths * np.log1p(marks) * free
    scores: dict[int, list[float]] = {}
    for b, score in zip(blocks, fused.tolist(), strict=True):
        scores.setdefault(elements[b.element].path, []).append(score)
    limit = rules.threshold * float(fused.std())
    mean = {path: sum(s) / len(s) for path, s in scores.items()}
    best = max(mean.values())
    return {path for path, score in mean.items() if score >= min(limit, best) and score > 0} or {
        max(mean, key=lambda p: (mean[p], paths[p][1]))}


def main_blocks(blocks: list[Block], elements: list[Element], root: int, chosen: set[int],
                rules: PathRules) -> list[Block]:
    """What stays of the blocks of the main element: see the head of this module."""
    outer = [-1] * len(elements)  # the outermost list, table, quotation or figure under the root
    for at in range(root + 1, len(elements)):
        above = elements[at].parent
        outer[at] = outer[above] if above > root and outer[above] >= 0 else at if elements[at].tag in UNITS else -1
    units, sums = [outer[b.element] for b in blocks], {}
    for b, unit in zip(blocks, units, strict=True):
        total = sums.setdefault(unit, [0, 0])
        total[0] += len(b.text)
        total[1] += min(b.linked, len(b.text))
    # A path is judged by all its blocks; one that is mostly linked text itself is no part of the running text.
    keep = [sums[unit][1] <= rules.linked * sums[unit][0] if unit >= 0 else
            elements[b.element].path in chosen and b.linked <= rules.linked * len(b.text)
            for b, unit in zip(blocks, units, strict=True)]
    linked = True  # whether mostly linked text, or nothing, follows
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        block_linked = b.linked > rules.linked * len(b.text)
        if elements[b.element].tag in HEADINGS and units[i] < 0:
            keep[i] = keep[i] or elements[b.element].tag == "h1" or not (linked or block_linked)
        elif keep[i]:
            linked = False
        elif block_linked:
            linked = True
    return [b for b, stays in zip(blocks, keep, strict=True) if stays]


def extract(html: str, rules: PathRules = PathRules()) -> str:
    """The main text of one page."""
    reader = PageReader(html)
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:  # markup that the parser gives up on: what was read so far counts
        pass
    elements, blocks = reader.elements, []
    for b in reader.blocks:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
        if b.text:
            b.stops = len(PUNCTUATION.findall(b.text))
            blocks.append(b)
            e = elements[b.element]
            e.text, e.linked, e.stops = e.text + len(b.text), e.linked + min(b.linked, len(b.text)), e.stops + b.stops
    if not blocks:
        return ""
    for e in reversed(elements[1:]):  # children come after their parents
        above = elements[e.parent]
        above.text, above.linked, above.stops = above.text + e.text, above.linked + e.linked, above.stops + e.stops
        above.holds_main, above.holds_top = above.holds_main or e.holds_main, above.holds_top or e.holds_top
    total = elements[0].text

    def left_out(e: Element) -> bool:
        """Whether the element is marked itself, and the mark is to be believed; headers aside."""
        if not e.own:
            return False
        if e.mark in ("tag", "comment"):
            return not (e.mark == "comment" and e.holds_top)
        if e.mark in ("name", "wrap"):
            return not e.holds_main and 2 * e.text <= total
        # A weak name needs the text to agree: mostly linked, or not a single sentence.
        return e.mark == "weak" and not e.holds_main and (e.linked > rules.linked * e.text or not e.stops)

    verdicts = [False] * len(elements)
    titled = [False] * len(elements)  # in a header of the article, whose headings count
    for at in range(1, len(elements)):
        e = elements[at]
        header = e.own and e.mark == "header"
        of_main = header and elements[e.parent].main
        verdicts[at] = verdicts[e.parent] or left_out(e) or header and not of_main
        titled[at] = titled[e.parent] or of_main
    verdicts = {b.element: verdicts[b.element] or titled[b.element] and elements[b.element].tag not in HEADINGS
                for b in blocks}
    open_blocks = [b for b in blocks if not verdicts[b.element]]
    if not open_blocks:
        return ""
    chosen = content_paths(open_blocks, elements, rules)
    selected = [b for b in open_blocks if elements[b.element].path in chosen]
    weigh = [0] * len(elements)
    for b in selected:
        weigh[b.element] += len(b.text)
    for at in range(len(elements) - 1, 0, -1):
        weigh[elements[at].parent] += weigh[at]
    weight = {at: w for at, w in enumerate(weigh) if w}
    whole = weight[0]
    # The main element with the most selected text, the innermost of equals; else the deepest that holds most of it.
    named = [at for at in weight if elements[at].main and (elements[at].tag in ("article", "main") or not elements[
        elements[at].parent].main) and elements[at].mark in ("", "wrap", "weak")]
    if named:
        best = max(weight[at] for at in named)
        root = max(at for at in named if 10 * weight[at] >= 9 * best)
        if 4 * weight[root] >= whole:
            under = _under(elements, root)
            inside = [b for b in open_blocks if under[b.element]]
            return "\n".join(b.text for b in main_blocks(inside, elements, root, chosen, rules))
    root = max((at for at in weight if 10 * weight[at] >= 9 * whole and elements[at].container == at), default=0)
    under = _under(elements, root)
    inside = [b for b in open_blocks if under[b.element]]
    keep = [elements[b.element].path in chosen for b in inside]
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    while first > 0 and elements[inside[first - 1].element].tag in HEADINGS:
        first -= 1
    return "\n".join(
        b.text for i, b in enumerate(inside)
        if first <= i <= last and (keep[i] or b.linked <= rules.linked * len(b.text)))


def main_text(pages: DataFrame, rules: PathRules = PathRules(), keys: tuple[str, ...] = ("page_id", "url"),
              html: str = "html") -> DataFrame:
    """The key columns and the text of every page. Page by page: no shuffle."""
    rows = pages.select(*keys, whole_text(pages, html).alias("html_of_page"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), rules) for page in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keys))], pa.array(texts, pa.string())], [*keys, "text"])

    return rows.mapInArrow(work, f"{fields}, text string")
