"""Text and tables from web pages.

The standard parser turns one page into lists of parts inside a ``mapInArrow`` task; everything else
(which parts to use, how to join them, fallbacks) is expressed on columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablesight.functions.nulls import col

_HIDDEN = ("script", "style")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
         "track", "wbr")
_FIGURE_ATTRIBUTES = ("data-plotly", "data-figure", "data-chart")
_LISTS = ("meta", "headings", "visible", "alts", "arias", "titles", "data", "tables", "scripts", "figures")

PAGE_SCHEMA = "title string, " + ", ".join(f"{n} array<string>" for n in _LISTS) + ", source string"
# Parts are handed on when the pages they come from reach this many characters, so a task holds no more of them, however large pages are.
PAGES_AT_ONCE = 1 << 20

# Tags whose attributes, if any, are all quoted, and runs of comments without ``--`` in them: what every version of the parser reads alike.
_ATTRIBUTE = r"""\s+([a-zA-Z][-\w]*)=(?:"([^"]*)"|'([^']*)')"""
_PLAIN_START = re.compile(rf"""<([a-zA-Z][a-zA-Z0-9]*)((?:{re.sub(r"[(](?![?])", "(?:", _ATTRIBUTE)})*+)>""", re.ASCII)
_PLAIN_ATTRIBUTE = re.compile(_ATTRIBUTE, re.ASCII)
_PLAIN_END = re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
_COMMENT = "<!--(?!-?>)[^-]*+(?:-(?!-)[^-]*+)*+-->"
_COMMENTS = re.compile(rf"{_COMMENT}(?:\s*+{_COMMENT})*+")
_RAW = ("title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext")


# What a start tag ends when the page leaves the end tag out: the open element of these kinds, unless one of the
# others was opened within it since.
_BLOCKS = ("table", "td", "th", "caption", "button", "div", "section", "article", "blockquote", "ul", "ol", "li", "form")
_ENDS = {
    **{tag: (("td", "th"), ("table",)) for tag in ("td", "th")}, "tr": (("tr",), ("table",)), "li": (("li",), ("ul", "ol", "table")),
    **{tag: (_HEADINGS, _BLOCKS) for tag in _HEADINGS}, "p": (("p",), _BLOCKS), "option": (("option",), ("select",)),
    **{tag: (("dt", "dd"), ("dl",)) for tag in ("dt", "dd")},
}


class _Page(HTMLParser):
    """Collects the parts of one page in time linear in its length. Tags that may be left out are implied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.parts: dict[str, list] = {n: [] for n in _LISTS}
        self.open: list[tuple[str, list | None]] = []
        self.places: dict[str, list[int]] = {}  # of each tag, where it is open
        self.hidden = 0
        self.script_type: str | None = None

    def _last(self, tags) -> int:
        last = -1
        for tag in tags:
            places = self.places.get(tag)
            if places and places[-1] > last:
                last = places[-1]
        return last

    def updatepos(self, i, j):
        return j  # lines are not counted

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        tag = plain[1].lower() if plain else ""
        if not plain or tag in _RAW:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [(name.lower(), unescape(a or b)) for name, a, b in _PLAIN_ATTRIBUTE.findall(plain[2])] if plain[2] else ())
        if tag in _HIDDEN:
            self.set_cdata_mode(tag)
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def parse_comment(self, i, report=1):
        comments = _COMMENTS.match(self.rawdata, i)
        return comments.end() if comments else super().parse_comment(i, report)

    def handle_starttag(self, tag, attrs):
        self._attributes(tag, [(k, v or "") for k, v in attrs])
        if tag in _VOID:
            return
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            place = self._last(ended)
            if place >= 0 and (place > self._last(within if tag != "tr" else ("table",)) or (tag in ("td", "th") and place > self._last(("table",)))):
                self._close(place)
        # Headings and cells are ranges of the visible texts; rows and tables hold what is in them.
        collected: list | None = None
        here = len(self.parts["visible"])
        if tag in _HEADINGS:
            collected = [here, None]
            self.parts["headings"].append(collected)
        elif tag == "table":
            collected = []
            self.parts["tables"].append(collected)
        elif tag == "tr" and (place := self._last(("table",))) >= 0:
            collected = []
            self.open[place][1].append(collected)
        elif tag in ("td", "th") and (place := self._last(("tr",))) > self._last(("table",)) and self.open[place][1] is not None:
            collected = [here, None]
            self.open[place][1].append(collected)
        elif tag == "title" and self.title is None:
            self.title = ""
        elif tag == "script":
            self.script_type = dict(attrs).get("type") or ""
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, collected))
        self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.places.get(tag):
            self._close(self.places[tag][-1])

    def _close(self, place: int) -> None:
        """Close the element at ``place`` and all that are open within it."""
        for tag, collected in reversed(self.open[place:]):
            self.places[tag].pop()
            self.hidden -= tag in _HIDDEN
            if collected is not None and tag not in ("table", "tr"):
                collected[1] = len(self.parts["visible"])
        del self.open[place:]

    def handle_data(self, data):
        inner = self.open[-1][0] if self.open else ""
        text = data.strip()
        if self.hidden:
            if inner == "script" and text:
                self.parts["scripts"].append(f"{self.script_type}\n{text}")
            return
        if inner == "title" and self.title == "":
            self.title = text
        if text:
            self.parts["visible"].append(text)

    def _attributes(self, tag, attrs):
        for name, value in attrs:
            value = value.strip()
            if not value:
                continue
            if name == "content" and tag == "meta":
                self.parts["meta"].append(value)
            elif name == "alt" and tag == "img":
                self.parts["alts"].append(value)
            elif name == "aria-label":
                self.parts["arias"].append(value)
            elif name == "title":
                self.parts["titles"].append(value)
            elif name.startswith("data-"):
                self.parts["data"].append(value)
                if name.startswith(_FIGURE_ATTRIBUTES):
                    self.parts["figures"].append(value)

    def result(self) -> list:
        self._close(0)
        p = self.parts
        joined = lambda span: " ".join(p["visible"][span[0]:span[1]])
        p["headings"] = [h for h in map(joined, p["headings"]) if h]
        tables = [[" | ".join(map(joined, row)) for row in t if row] for t in p["tables"]]
        p["tables"] = ["\n".join(rows) for rows in tables if rows]
        return [self.title, *[p[n] for n in _LISTS]]


def _parse(html: str | None) -> list:
    page = _Page()
    page.feed(html or "")
    page.close()
    found = page.result()
    textless = not page.title and not any(page.parts[n] for n in _LISTS if n not in ("scripts", "figures"))
    return [*found, html if textless else None]


def page_parts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per page: its key and the parts listed in ``PAGE_SCHEMA``.

    The page's source is passed on only where there is neither text nor table in it, which is where it is
    still needed; so a page is read and parsed once.
    """
    names = [key, "title", *_LISTS, "source"]
    kinds = [pa.string(), *[pa.list_(pa.string())] * len(_LISTS), pa.string()]

    def packed(keys: pa.Array, parts: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*parts), kinds))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, begin, parts, size = batch.column(0), 0, [], 0
            for i, text in enumerate(batch.column(1), 1):
                source = text.as_py()
                parts.append(_parse(source))
                size += len(source or "")
                if size >= PAGES_AT_ONCE or i == batch.num_rows:
                    yield packed(keys.slice(begin, i - begin), parts)
                    begin, parts, size = i, [], 0

    key_type = pages.schema[key].dataType.simpleString()
    return pages.select(col(key), col(html)).mapInArrow(run, f"`{key}` {key_type}, {PAGE_SCHEMA}")


def page_text() -> Column:
    """Text of a page from its parts, in the order title, meta, headings, visible text, attributes."""
    lines = lambda name: F.array_join(name, "\n")
    parts = F.concat(
        F.array(F.col("title")), F.col("meta"), F.col("headings"),
        F.array(lines("visible"), lines("alts"), lines("arias"), lines("titles")), F.col("data"))
    return F.array_join(F.filter(F.array_compact(parts), lambda p: p != ""), "\n")


def blank_to_null(text: Column) -> Column:
    """The text unless it is blank. Bound to a name, so that a costly text is made only once."""
    return F.transform(F.array(text), lambda t: F.when(F.rlike(t, F.lit(r"(?U)\S")), t))[0]
