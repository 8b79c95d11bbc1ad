"""HTML pages → node arrays, one row per page.

The shredder is a small helper inside ``mapInArrow``: Spark splits the pages, each task turns its batches into one flat
array of nodes per page in document order. ``end`` is the position of the last descendant, so a subtree is a slice of
the array and every page operator stays within its row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

NODES = (
    "array<struct<id:int,parent:int,end:int,depth:int,tag:string,attrs:map<string,string>,text:string,path:string>>"
)
# fixed values: elements without content, elements that end an open paragraph, and which open element a start tag ends
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
PARAGRAPH_SCOPE = {"article", "section", "main", "div", "td", "th", "li", "body", "html", "aside", "nav", "header", "footer"}
#: Elements whose content is no markup, or not always.
RAW = set("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
#: Plain tags and texts, read the same by every parser: quoted attributes without references, nothing left open.
_PLAIN = re.compile(r"""<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9:_-]*="[^"&\0]*")*)[ \t\n]*(/?))>|([^<]+)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)="([^"]*)\"""")


class _Shredder(HTMLParser):
    """Flat lists of nodes for one page; open elements are kept on a stack."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []

    def _open(self, tag: str, attrs, text) -> int:
        parent = self.stack[-1] if self.stack else 0
        above = self.rows[parent - 1] if parent else None
        path = f"{above[7]}/{above[4]}" if above else ""
        number = len(self.rows) + 1
        self.rows.append([number, parent, number, len(self.stack), tag, attrs, text, path])
        return number

    def read_plain(self, html: str) -> int:
        """Read plain markup up to the place, which is returned, where only a full parser knows what follows."""
        at, match = 0, _PLAIN.match
        while token := match(html, at):
            close, tag, attributes, empty, text = token.groups()
            if text:
                self._open("#text", None, unescape(text) if "&" in text else text)
            elif close:
                self.handle_endtag(close.lower())
            else:
                tag = tag.lower()
                if tag in RAW:
                    break
                attrs = [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else []
                (self.handle_startendtag if empty else self.handle_starttag)(tag, attrs)
            at = token.end()
        return at

    def _close_to(self, depth: int) -> None:
        last = len(self.rows)
        for number in self.stack[depth:]:
            self.rows[number - 1][2] = last
        del self.stack[depth:]

    def _close_open(self, targets: set[str], scope: set[str]) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.rows[self.stack[depth] - 1][4]
            if tag in targets:
                self._close_to(depth)
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close_open({"p"}, PARAGRAPH_SCOPE)
        if tag in IMPLIED_END:
            self._close_open(*IMPLIED_END[tag])
        number = self._open(tag, [(k, v or "") for k, v in dict(reversed(attrs)).items()] if attrs else [], None)
        if tag not in VOID:
            self.stack.append(number)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[depth] - 1][4] == tag:
                self._close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        self._open("#text", None, data)


def shred_page(html: str | None) -> list[list]:
    html = html or ""
    parser = _Shredder()
    at = parser.read_plain(html)
    if at < len(html):
        parser.feed(html[at:])
    parser.close()
    parser._close_to(0)
    return parser.rows


_FIELDS = [
    pa.field("id", pa.int32()), pa.field("parent", pa.int32()), pa.field("end", pa.int32()), pa.field("depth", pa.int32()),
    pa.field("tag", pa.string()), pa.field("attrs", pa.map_(pa.string(), pa.string())), pa.field("text", pa.string()),
    pa.field("path", pa.string()),
]


def _maps(column) -> pa.Array:
    starts, pairs = [], []
    for attrs in column:
        starts.append(None if attrs is None else len(pairs))
        pairs.extend(attrs or ())
    starts.append(len(pairs))
    return pa.MapArray.from_arrays(pa.array(starts, pa.int32()), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))


def _nodes_array(pages: list[list[list]]) -> pa.Array:
    offsets, flat = [0], []
    for rows in pages:
        flat.extend(rows)
        offsets.append(len(flat))
    columns = [pa.array(c, f.type) if f.name != "attrs" else _maps(c) for c, f in zip(zip(*flat) if flat else [()] * len(_FIELDS), _FIELDS)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=_FIELDS))


def shred_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the HTML column by ``nodes``; the other columns pass through."""
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", nodes {NODES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # bounds the memory a batch of large pages takes
                part = batch.slice(start, 64)
                nodes = _nodes_array([shred_page(h) for h in part.column(html).to_pylist()])
                arrays = [part.column(f.name) for f in kept] + [nodes]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + ["nodes"])

    from feedweir.operators.partitioning import spread

    return spread(pages.select(*[f.name for f in kept], html)).mapInArrow(run, schema)
