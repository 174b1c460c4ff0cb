"""Pages as intervals: one linear reader numbers a page's elements in page order, and all that lies between an element's own number and its last descendant's lies inside it.

The reader goes over a page once. It never raises: a tag that isn't one is text, an end tag that closes nothing is passed over, and start tags close what they end by rule (an item the item before it, a heading
or a block the paragraph before it). Texts are kept once for a page, as a stream; an element's text is a stretch of it. So a page takes time in proportion to its length whatever its nesting, and every question about ancestors is a
comparison of numbers: an element is inside another if its number is above the other's and at most the other's `last`."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html import unescape
from html.entities import html5
from urllib.parse import urljoin

import pyarrow as pa

#: Texts of more characters are not listed (null): no rule takes so long a title, and a page of nested elements would repeat them for each.
LONGEST_TEXT = 2_000
#: Rows of pages that are read at once, and their bytes.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20

# Fixed values, from the rules of HTML: elements without end tags, those whose content is no text, what a start tag closes, and where closing stops.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
HIDDEN = frozenset("script style noscript iframe template svg".split())
BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "a": ("a",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "a": ("table",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ZONES = frozenset(("nav", "header", "footer"))

_TAG = re.compile(r"<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>\x00]*))")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=\x00]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
_SPACE = re.compile(r"\s+")
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([a-zA-Z][a-zA-Z0-9]*));")


def closed_references(text: str) -> str:
    """The text with the character references decoded that end in a semicolon; one that is cut off stays as it is written."""
    return _CLOSED.sub(lambda m: unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], text) if "&" in text else text


def tokens(html: str) -> Iterator[tuple[str, str, dict | None]]:
    """(kind, name or text, attributes): kind is "text", "start" or "end". Each character is passed once."""
    at, n = 0, len(html)
    lower = None
    gone: set[str] = set()  # raw elements of which no end tag is left
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            yield "text", html[at:], None
            return
        if m.start() > at:
            yield "text", html[at : m.start()], None
        if m[3] is None:  # a comment, a declaration: up to its end, or else the page's
            end = html.find("-->" if m[0] == "<!--" else ">", m.end())
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        name, at = m[3].lower(), _tag_end(html, m.end())
        if m[2]:
            yield "end", name, None
            continue
        inside = html[m.end() : at - 1 if html[at - 1 : at] == ">" else at]
        yield "start", name, {k.lower(): unescape(a or b or c or "") for k, a, b, c in reversed(_ATTRIBUTE.findall(inside))} if inside.strip("/ \n\t\r") else {}
        if name in RAW and name not in gone:
            lower = html.lower() if lower is None else lower
            if len(lower) != n:  # a letter whose lower case is longer
                lower = "".join(c.lower() if c.isascii() else c for c in html)
            end = lower.find(f"</{name}", at)
            if end < 0:
                gone.add(name)
                end = n if name in HIDDEN else at
            if end > at:
                yield "raw", html[at:end], None
            at = end


def _tag_end(html: str, at: int) -> int:
    """After the tag's >, which may stand in a quoted value; an unclosed quote ends at the next >."""
    end = html.find(">", at)
    if end < 0:
        return len(html)
    quote = re.compile("[\"']").search(html, at, end)
    while quote:
        close = html.find(quote[0], quote.end())
        if close < 0 or close - quote.start() > 20_000:
            return end + 1
        end = html.find(">", close + 1) if close > end else end
        if end < 0:
            return len(html)
        quote = re.compile("[\"']").search(html, close + 1, end)
    return end + 1


class Page:
    """A page's elements as columns, in page order: tag, attributes, last (the last descendant's number), parent (-1: none), and the stretch of the page's text."""

    def __init__(self, html: str, decode: Callable[[str], str] = unescape):
        self.tag, self.attributes, self.last, self.parent, self.begin, self.end, self.hidden = [], [], [], [], [], [], []
        self.parts: list[str] = []  # the text
        self.owner: list[int] = []  # of each part: the element whose own text it is
        self._open: list[int] = []
        self._names: dict[str, int] = {}  # of open elements by tag
        self._hidden = 0
        for kind, value, attributes in tokens(html):
            if kind == "start":
                self._start(value, attributes)
            elif kind == "end":
                self._end(value)
            elif not self._hidden:
                self._text(decode(value))
        while self._open:
            self._close()

    def _start(self, tag: str, attributes: dict) -> None:
        if tag in BLOCK and self._names.get("p"):
            self._close_to(("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            self._close_to(CLOSES[tag], STOPS[tag])
        k = len(self.tag)
        self.tag.append(tag), self.attributes.append(attributes), self.last.append(k), self.parent.append(self._open[-1] if self._open else -1), self.begin.append(len(self.parts)), self.end.append(len(self.parts)), self.hidden.append(self._hidden > 0)
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        self._open.append(k)
        self._names[tag] = self._names.get(tag, 0) + 1
        self._hidden += tag in HIDDEN

    def _text(self, text: str) -> None:
        if not self._hidden:
            self.parts.append(text)
            self.owner.append(self._open[-1] if self._open else -1)

    def _close(self) -> None:
        k = self._open.pop()
        tag = self.tag[k]
        self._names[tag] -= 1
        self._hidden -= tag in HIDDEN
        self.last[k] = len(self.tag) - 1
        self.end[k] = len(self.parts)

    def _close_to(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close the innermost open element of tags, and what is open in it, unless one of stops is nearer."""
        if not any(self._names.get(t) for t in tags):
            return
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self.tag[self._open[depth]]
            if tag in tags:
                while len(self._open) > depth:
                    self._close()
                return
            if tag in stops:
                return

    def _end(self, tag: str) -> None:
        if self._names.get(tag):
            while self.tag[self._open[-1]] != tag:
                self._close()
            self._close()

    def texts(self, longest: int = LONGEST_TEXT) -> list[str | None]:
        """Each element's text with single blanks; null if it is longer than `longest`."""
        length = [0]
        for part in self.parts:
            length.append(length[-1] + len(part))
        return [_SPACE.sub(" ", "".join(self.parts[b:e])).strip() if length[e] - length[b] <= longest else None for b, e in zip(self.begin, self.end, strict=True)]

    def own_texts(self) -> list[str]:
        """What stands in an element itself, not in its descendants."""
        own: dict[int, list[str]] = {}
        for k, part in zip(self.owner, self.parts, strict=True):
            own.setdefault(k, []).append(part)
        return [_SPACE.sub(" ", "".join(own.get(k, ()))).strip() for k in range(len(self.tag))]


ELEMENT = "page_id long, base string, pos int, last int, parent int, tag string, text string, own string, href string, raw_href string, title string, classes string, section string, near string, zone string, holds array<string>"
COLUMNS = [c.split()[0] for c in ELEMENT.split(", ")]
KINDS = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 10, pa.list_(pa.string())]

#: How many ancestors are searched for a card's heading, and for a section's; how long a card's heading is.
UP, UP_SECTION, HEADING_LENGTH = 5, 6, (3, 120)


def _before(places: list[int], k: int) -> int:
    """The last of the places before k, or -1."""
    i = bisect_right(places, k - 1)
    return places[i - 1] if i else -1


class Places:
    """Where a page's headings, bold texts and containers stand: each question is a search in sorted numbers."""

    def __init__(self, page: Page, texts: list[str | None]):
        self.page, self.texts = page, texts
        self.headings = [k for k, tag in enumerate(page.tag) if tag in HEADINGS and texts[k]]
        self.fitting = [k for k in self.headings if HEADING_LENGTH[0] <= len(texts[k]) <= HEADING_LENGTH[1]]
        self.bold: dict[int, list[int]] = {}  # by parent
        self.of_tag: dict[str, list[int]] = {"heading": [k for k, tag in enumerate(page.tag) if tag in HEADINGS and tag != "h6"]}
        for k, tag in enumerate(page.tag):
            if tag in ("b", "strong") and texts[k]:
                self.bold.setdefault(page.parent[k], []).append(k)
            if tag in ("li", "p"):
                self.of_tag.setdefault(tag, []).append(k)

    def near(self, k: int) -> str | None:
        """In the first of the UP next ancestors below the body that has headings of fitting length, the last of them."""
        up = self.page.parent[k]
        for _ in range(UP):
            if up < 0 or self.page.tag[up] in ("body", "html"):
                break
            if (found := _before(self.fitting, self.page.last[up] + 1)) > up:
                return self.texts[found]
            up = self.page.parent[up]
        return None

    def section(self, k: int) -> str:
        """The heading or bold text among what stands before the element, beside it or beside one of its next ancestors: the nearest."""
        for _ in range(UP_SECTION):
            up = self.page.parent[k]
            heading = _before(self.headings, k)
            if heading >= 0 and self.page.last[heading] >= k:  # it is around the element
                heading = _before(self.headings, heading)
            found = max(heading if heading > up else -1, _before(self.bold.get(up, []), k))
            if found >= 0:
                return self.texts[found] or ""
            if up < 0 or self.page.tag[up] == "body":
                break
            k = up
        return ""

    def holds(self, k: int) -> list[str]:
        return sorted(name for name, places in self.of_tag.items() if _before(places, self.page.last[k] + 1) > k)


def element_rows(page_id: int | None, url: str | None, html: str | None, listed: frozenset[str], classes: re.Pattern | None = None, decode: Callable[[str], str] = unescape) -> list[tuple]:
    """Rows of ELEMENT, of the elements of `listed` tags or of a class that `classes` finds. near: `Places.near`, of links; section: `Places.section`; zone: the nav, header or footer around; holds: which of heading, li and p are inside."""
    page = Page(html or "", decode)
    texts, own = page.texts(), page.own_texts()
    places, zone, rows = Places(page, texts), [], []
    for k, (tag, up) in enumerate(zip(page.tag, page.parent, strict=True)):
        zone.append(tag if tag in ZONES else zone[up] if up >= 0 else None)
        a = page.attributes[k]
        if not page.hidden[k] and (tag in listed or classes is not None and classes.search(a.get("class", ""))):
            near = places.near(k) if tag == "a" else None
            rows.append((page_id, url, k, page.last[k], up, tag, texts[k], own[k], absolute(url, a.get("href")), a.get("href"), a.get("title"), a.get("class", ""), places.section(k), near, zone[k], places.holds(k)))
    return rows


def absolute(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href.strip()) if href is not None else None
    except ValueError:
        return None


def scripts(html: str, kind: str) -> Iterator[str]:
    """The contents of the page's scripts whose type has `kind` in it."""
    wanted = False
    for what, value, attributes in tokens(html):
        if what == "raw" and wanted:
            yield value
        wanted = what == "start" and value == "script" and kind in attributes.get("type", "").lower()


def slices(batches, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """The batches in slices of at most `rows` rows and about `size` bytes (one row at least)."""
    for batch in batches:
        mean, at = max(1, batch.get_total_buffer_size() // max(1, batch.num_rows)), 0
        step = int(max(1, min(rows, size // mean)))
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at += step
