"""Main-text extraction: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events into lines, one for each block of text, each with the number of tags met
on the way. A line's ratio of text to tags is smoothed with its neighbours'; lines over the threshold (the spread of
the smoothed ratios) are the content cluster. The content region is the deepest element with most of the cluster's
text. Tags refine it: a region inside an article or main element grows to that element, and one that holds such
elements with most of its content shrinks to them. Of any other region the cluster sets the bounds: units (a list, table or
quotation is one, any other line one of its own) before its first and after its last content line go, save those next to
it that read on: headings, paragraphs, and lists, tables, preformatted text and plain blocks beside content of the same
parent, unless they are mostly links. All lines within the bounds are kept, short ones too, save those inside elements
that are no article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments),
known by their tags or by whole names in class, id and role. Neither a name nor a form hides a wrapper: an element with
nearly all of the text, or with most of it and the page's heading. An iframe, button or the like without an end tag
hides what follows only up to the next block.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that have a place in the tree: regions, and what hides what it holds. Others (p, b, h1, ...) need no closing tag.
_CONTAINERS = frozenset("html body main article section div nav aside header footer form table tbody thead tr td th ul ol dl li blockquote figure dialog menu fieldset template noscript head datalist".split())
#: Elements inside a line whose text is none of it.
_MUTED = frozenset("select button iframe svg object video audio canvas".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 hr pre dt dd figcaption address caption title option legend details summary center".split())
_NEVER = frozenset("nav aside footer script style noscript template head title dialog menu textarea option datalist".split()) | _MUTED
#: Elements that hide what they hold unless they are wrappers, as a form around a whole page is.
_FORMS = frozenset({"form", "fieldset"})
#: Lists, tables and quotations: at the edges of a region their lines stay or go together.
_GROUPS = frozenset("ul ol dl table blockquote figure".split())
#: Muted elements that never hold one of their kind.
_FLAT = frozenset("select button iframe video audio canvas".split())
_ENDS = re.compile(rf"<(/?)({'|'.join(sorted(_FLAT))})(?=[\s/>])", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in class, id and role that mark an element as no article text, and words that may stand beside one in a name, as in site-header or ad-slot.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup paywall popup modal overlay sidebar side widget widgets related recommended recommendations trending share sharing social "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead header topbar toolbar comment comments commentlist disqus respond reply replies "
    "discussion login complementary contentinfo search".split()
)
_BESIDE = frozenset(
    "site page main top bottom left right primary secondary global block box area list section wrap wrapper container inner content bar posts post links link items item text message form button buttons "
    "google slot unit label media user reader thread the div section region panel column col group icons icon sticky fixed mobile desktop".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NONE = re.compile(r"display\s*:\s*none")
#: Start tags that can stand in a head; any other one ends it.
_HEAD = frozenset("head title base link meta style script noscript template".split())
SIGMA, SHARE = 1.0, 0.6
#: Shares of all text with which an element is a wrapper, whatever its name: alone, and with the page's heading in it.
WRAPS, WRAPS_HEADING = 0.9, 0.5


def marks(attrs: dict[str, str]) -> set[str]:
    """The marks among the names in class, id and role. A compound name counts if each of its words is a mark or may stand beside one."""
    found: set[str] = set()
    for name in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
        words = {w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if w and not w.isdigit()}
        if all(w in _MARKS or w in _BESIDE for w in words):
            found |= words & _MARKS
    return found


class _Lines(HTMLParser):
    """Collects lines (text, tags, container, block's tag, hidden by it, characters in links) and the tree of containers; a container's number is over its parent's."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.ends: dict[str, list[tuple[int, bool]]] = {}  # where tags of flat elements stand, and whether they are end tags
        for m in _ENDS.finditer(html):
            self.ends.setdefault(m[2].lower(), []).append((m.start(), bool(m[1])))
        self.loose: set[int] = set()  # open muted elements without an end tag: they end at the next block
        self.lines: list[tuple[str, int, int, str, bool, int]] = []
        self.names, self.parents, self.hidden, self.marked, self.headed = [""], [-1], [False], [set()], [False]
        self.prose = [False]
        self.stack = [0]
        self.open: Counter = Counter()  # how many of each tag are on the stack
        self.skip: str | None = None  # inside an element without a container's place, such as script
        self.parts: list[str] = []
        self.tags = self.links = self.linked = 0
        self.block, self.gone = "", False

    def _break(self, block: str = "", gone: bool = False) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = next(n for n in reversed(self.stack) if self.names[n] not in _MUTED)  # what a muted element interrupts is not in it
            self.lines.append((text, self.tags, at, self.block, self.gone, self.linked))
            self.tags = 0
        self.parts.clear()
        self.linked, self.block, self.gone = 0, block, gone

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br" and not self._muted():
            self.parts.append(" ")
        if tag == "a":
            self.links = 1
        if tag in _VOID and tag != "hr":
            return
        if tag not in _HEAD and self.open["head"]:
            self._break()
            self._close("head")
        if self.skip == "option" and tag in _CONTAINERS:
            self.skip = None
        if tag in _BLOCKS or tag in _FLAT and self.open[tag]:
            self._tighten()
        own = {k: v or "" for k, v in attrs}
        unseen = "hidden" in own or own.get("aria-hidden") == "true" or bool(_NONE.search(own.get("style", "")))
        if tag in _BLOCKS:
            self._break(tag, tag not in _CONTAINERS and (unseen or tag not in _HEADINGS and bool(marks(own))))
        if tag == "p" or tag in _HEADINGS:
            self.prose[self.stack[-1]] = True
        if tag in ("h1", "main", "article"):
            self.headed[self.stack[-1]] = True
        if tag in _CONTAINERS or tag in _MUTED:
            inner = self.open["article"] or self.open["main"]  # a header in there is the article's own
            never = tag in _NEVER or tag == "header" and not inner
            free = tag in ("html", "body", "main", "article")
            self.names.append(tag)
            self.parents.append(self.stack[-1])
            self.hidden.append(never or unseen and not free)
            self.marked.append(set() if free else marks(own) - {"header"} if inner else marks(own))
            self.headed.append(tag in ("main", "article"))
            self.prose.append(tag in ("main", "article"))
            if tag in _FLAT and not self._ended(tag):
                self.loose.add(len(self.names) - 1)
            self.stack.append(len(self.names) - 1)
            self.open[tag] += 1
        elif tag in _NEVER:
            self.skip = self.skip or tag

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag == self.skip:
            self.skip = None
        if tag in _BLOCKS:
            self._break()
            self._tighten()
        if self.open[tag]:
            if self.skip == "option":  # its end tag may be left out: it ends with what holds it
                self.skip = None
            self._close(tag)

    def _ended(self, tag: str) -> bool:
        """Whether the flat element that starts here has an end tag before the next one of its kind starts."""
        line, column = self.getpos()
        places = self.ends.get(tag, [])
        at = bisect.bisect_right(places, (self.starts[line - 1] + column, True))
        return at < len(places) and places[at][1]

    def _tighten(self) -> None:
        """Ends the muted elements that have no end tag."""
        while self.loose:
            self._close(self.names[min(self.loose)])

    def _close(self, tag: str) -> None:
        while True:
            n = self.stack.pop()
            self.loose.discard(n)
            closed = self.names[n]
            self.open[closed] -= 1
            if closed == tag:
                return

    def _muted(self) -> bool:
        return self.names[self.stack[-1]] in _MUTED

    def handle_data(self, data: str) -> None:
        if self.skip is None and not self._muted():
            self.parts.append(data)
            self.linked += self.links * len(data)


def _sums(parents: list[int], at: list[int], values: list[int]) -> list[int]:
    """For each container what lies in it at any depth: ``values`` of lines in containers ``at``."""
    out = [0] * len(parents)
    for n, v in zip(at, values, strict=True):
        out[n] += v
    for n in range(len(parents) - 1, 0, -1):
        out[parents[n]] += out[n]
    return out


def _hide(page: _Lines) -> list[bool]:
    """Which containers are hidden, by their tags, by their names, or by one around them."""
    parents, headed, prose = page.parents, list(page.headed), list(page.prose)
    for n in range(len(parents) - 1, 0, -1):
        headed[parents[n]] = headed[parents[n]] or headed[n]
        prose[parents[n]] = prose[parents[n]] or prose[n]
    hidden = list(page.hidden)
    for n in range(1, len(parents)):
        hidden[n] = hidden[n] or hidden[parents[n]]
    if any(name in _FORMS for name in page.names):
        shown = [x for x in page.lines if not hidden[x[2]] and not x[4]]
        held = _sums(parents, [x[2] for x in shown], [len(x[0]) for x in shown])
        for n in range(1, len(parents)):
            share = held[n] / max(1, held[0])
            wraps = prose[n] and share >= WRAPS or headed[n] and share > WRAPS_HEADING
            hidden[n] = hidden[n] or hidden[parents[n]] or page.names[n] in _FORMS and not wraps
    shown = [x for x in page.lines if not hidden[x[2]] and not x[4]]
    held = _sums(parents, [x[2] for x in shown], [len(x[0]) for x in shown])
    for n in range(1, len(parents)):
        share = held[n] / max(1, held[0])
        wraps = headed[n] and share == 1 if page.marked[n] & _COMMENTS else share >= WRAPS or headed[n] and share > WRAPS_HEADING
        hidden[n] = hidden[n] or hidden[parents[n]] or bool(page.marked[n]) and not wraps
    return hidden


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; weights are normed at the edges."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + reach], values[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_lines(ratios: list[float]) -> list[bool]:
    """The cluster of high smoothed ratios: at or over their standard deviation. Where all are alike, all are content."""
    s = smooth(ratios)
    mean = sum(s) / len(s)
    spread = math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
    return [x >= spread for x in s]


def _region(page: _Lines, held: list[int]) -> int:
    """The deepest container with most of the content; lists' and tables' parts are no regions."""
    inside: dict[int, int] = {}
    for n in range(1, len(held)):
        if held[n] >= SHARE * held[0]:  # of one parent's children only one can have it
            inside[page.parents[n]] = n
    found = n = 0
    while n in inside:
        n = inside[n]
        if page.names[n] not in ("tr", "tbody", "li"):
            found = n
    return found


def _refined(page: _Lines, held: list[int], region: int) -> set[int]:
    """The article or main elements that the region stands for, if any."""
    names, parents = page.names, page.parents
    outer, n = 0, region
    while n > 0:
        if names[n] in ("article", "main"):
            outer = n
        n = parents[n]
    if outer:
        region = parents[outer]  # other articles beside it belong to the page's text too
        while region > 0 and names[region] not in ("body", "html"):
            region = parents[region]
    within, in_article, around = [n == region for n in range(len(names))], [False] * len(names), [0] * len(names)
    for n in range(1, len(names)):
        p = parents[n]
        within[n] = within[n] or within[p]
        in_article[n] = in_article[p] or names[p] == "article"
        around[n] = p if names[p] == "main" else around[p]  # the main element around it
    tops = [n for n in range(1, len(names)) if within[n] and held[n] and names[n] in ("article", "main") and not in_article[n]]
    mains = [n for n in tops if names[n] == "main"]
    main = max(mains, key=lambda n: (held[n], -n), default=None)
    inside = [n for n in tops if names[n] == "article" and main is not None and around[n] == main]
    outside = [n for n in tops if names[n] == "article" and not around[n]]
    if main is not None and held[main] >= sum(held[n] for n in outside):
        return set(inside if inside and sum(held[n] for n in inside) >= SHARE * held[main] else [main])
    articles = outside or [n for n in tops if names[n] == "article"]
    return set(articles) if sum(held[n] for n in articles) >= SHARE * held[region] else set()


def _bounds(page: _Lines, lines: list[tuple], good: list[bool], region: int) -> tuple[int, int]:
    """From where to where ``lines`` of a region without an element of its own are kept: whole units, ``good`` ones and what reads on beside them."""
    group = [0] * len(page.names)  # the outermost group inside the region around each container
    for n in range(1, len(group)):
        p = page.parents[n]
        group[n] = group[p] or (n if n > region and page.names[n] in _GROUPS else 0)
    units: list[list[int]] = []  # first line, last line, group
    for i, x in enumerate(lines):
        g = group[x[2]]
        if units and g and units[-1][2] == g:
            units[-1][1] = i
        else:
            units.append([i, i, g])
    linked = [2 * sum(x[5] for x in lines[a : b + 1]) >= sum(len(x[0]) for x in lines[a : b + 1]) for a, b, _ in units]
    content = [any(good[a : b + 1]) and not (g and mostly) for (a, b, g), mostly in zip(units, linked, strict=True)]
    if not any(content):
        return 0, len(lines)
    beside = {page.parents[g] if g else lines[a][2] for (a, _, g), c in zip(units, content, strict=True) if c}
    leaves = {page.parents[lines[a][2]] for (a, _, g), c in zip(units, content, strict=True) if c and not g and lines[a][3] == page.names[lines[a][2]]}

    def reads_on(u: int) -> bool:
        a, _, g = units[u]
        if linked[u]:
            return False
        if g:
            return page.parents[g] in beside
        _, _, n, block, *_ = lines[a]
        if block == "p" or block in _HEADINGS:
            return True
        return page.parents[n] in leaves if block and block == page.names[n] else n in beside and block in ("pre", "dt", "dd", "address", "figcaption")

    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    while first > 0 and reads_on(first - 1):
        first -= 1
    while last < len(units) - 1 and reads_on(last + 1):
        last += 1
    return units[first][0], units[last][1] + 1


def extract(html: str | None) -> str:
    """The article's text: blocks in page order, joined by a line feed; empty if there is none. Time and memory are in proportion to the page, however deep it is."""
    page = _Lines(html or "")
    page.feed(html or "")
    page.close()
    page._break()
    hidden = _hide(page)
    lines = [x for x in page.lines if not hidden[x[2]] and not x[4]]
    if not lines:
        return ""
    content = content_lines([len(x[0]) / max(1, x[1]) for x in lines])
    held = _sums(page.parents, [x[2] for x in lines], [len(x[0]) * good for x, good in zip(lines, content, strict=True)])
    region = _region(page, held)
    regions = _refined(page, held, region) or {region}
    inside = [n in regions for n in range(len(page.names))]
    for n in range(1, len(inside)):
        inside[n] = inside[n] or inside[page.parents[n]]
    kept = [n for n, x in enumerate(lines) if inside[x[2]]]
    if not any(page.names[n] in ("article", "main") for n in regions):
        first, last = _bounds(page, [lines[n] for n in kept], [content[n] for n in kept], region)
        kept = kept[first:last]
    return "\n".join(lines[n][0] for n in kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row, from its whole html, of any length and depth.

    A null or empty html, or one without article text, gives an empty text; a null page_id or url stays null; repeated
    rows give repeated results, other columns are left alone, and an empty table gives an empty result.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op6_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_text_tag_ratio": op6_text_tag_ratio}
SQL: dict[str, str] = {}
