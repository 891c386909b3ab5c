"""Markup to nodes, and each page's nodes to one nested row.

The only Python step of the extraction path: a stack-based tree builder on the
standard-library ``html.parser`` runs inside ``mapInArrow``.  It comes in two
forms:

* ``page_nodes``: one row per node (D1), for scans over all elements;
* ``page_trees``: one row per page with nested arrays -- the visible strings,
  the emitted blocks with their direct children, the elements that a root
  selector may pick, paragraph containers, metadata elements.  Everything the
  extraction does with a page is then an expression on its own row: no
  shuffle, no join, and no row that is copied once per ancestor.

Both are linear in the page: a node carries scalars taken from its parent
(nearest block, list, item depth) and subtree sums added up from its children,
never its list of ancestors.  Rules of selection, rendering and scoring are
not here but in Spark expressions (:mod:`pagelift.operators.markdown`).

Tree rules (those of the ``html.parser`` tree builder the extraction semantics
are defined against):

* unclosed elements nest -- there are no implied end tags;
* an end tag closes up to the nearest open element of that name, otherwise it
  is ignored;
* void elements never get children; ``<x/>`` is an empty element;
* ``script``/``style`` bodies are raw text, character references are decoded;
* consecutive character data forms one string; an all-ASCII-whitespace string
  becomes ``"\\n"`` or ``" "`` outside ``pre``/``textarea``.

Node kinds: ``element``; ``text`` (strings visible to text extraction, incl.
CDATA); ``comment``; ``other`` (doctype, declarations, processing instructions
and strings inside script/style/template/rt/rp, which text extraction skips).

Markup that the parser rejects gives ``parse_error`` and no tree.
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_left, bisect_right
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import parts_of

# The parser runs in executor Python workers: ship this module's code by value
# so the workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the tree builder.
VOID_TAGS = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
})
PRESERVE_WS_TAGS = ("pre", "textarea")
HIDDEN_STRING_TAGS = ("script", "style", "template", "rt", "rp")
#: Attributes whose value is a list: equal however its items are spaced.
LIST_ATTRIBUTES = frozenset({"class", "rel", "rev", "headers", "accesskey", "dropzone"})
ASCII_SPACES = "\x20\x0a\x09\x0c\x0d"

# Chrome removed before extraction.
DROP_TAGS = (
    "script", "style", "noscript", "svg", "canvas", "iframe", "nav",
    "footer", "header", "form", "button", "aside",
)
# Block tags (D7), those that hold inline text, and those a block may stand in.
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre",
              "blockquote", "table", "img")
INLINE_BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "li", "p")
NEST_OK = ("li", "blockquote")
PARAGRAPH_TAGS = ("p", "pre", "td")
ROOT_TAGS = ("main", "article", "body")
_PICKED = frozenset({"role", "id", "class"})
IMAGE_SOURCES = ("src", "data-src", "data-lazy-src", "data-original")

_DROP, _BLOCK, _INLINE = frozenset(DROP_TAGS), frozenset(BLOCK_TAGS), frozenset(INLINE_BLOCKS)


#: Tags without or with quoted attributes that hold nothing to decode; those that switch the parser's mode stay with it.
_PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&]*")*)>')
_PLAIN_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9-]*)="([^"]*)"')
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
_SPECIAL_TAGS = frozenset({"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"})


class Node:
    """A node of the flat document order; ``last`` is the last place in its subtree."""

    __slots__ = ("pre", "last", "parent", "depth", "kind", "tag", "text", "attrs", "sig", "dropped")

    def __init__(self, pre, parent, depth, kind, tag, text, attrs, dropped):
        self.pre, self.last, self.parent, self.depth, self.kind = pre, pre, parent, depth, kind
        self.tag, self.text, self.attrs, self.sig, self.dropped = tag, text, attrs, None, dropped


def _signature(tag: str, attrs: dict[str, str], parts: list[bytes]) -> bytes:
    """Digest of an element's structure: tag, attributes and the visible children in order."""
    own = hashlib.blake2b(tag.encode("utf-8", "surrogatepass"), digest_size=8)
    for name in sorted(attrs):
        value = " ".join(attrs[name].split()) if name in LIST_ATTRIBUTES else attrs[name]
        own.update(f"\x1f{name}\x1e{value}".encode("utf-8", "surrogatepass"))
    own.update(b"\x1d")
    for part in parts:
        own.update(part)
    return own.digest()


class _TreeBuilder(HTMLParser):
    """Builds the flat node list of one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.stack: list[Node] = []
        self.parts: list[list[bytes]] = []  # of each open element: structure of its visible children, where it stands in a list item
        self.buf: list[str] = []
        self.open: dict[str, int] = {}
        self.closed_void: dict[str, int] = {}
        self.preserved = self.hidden = self.items = 0  # open elements of these kinds

    def _add(self, kind: str, tag: str | None, text: str | None, attrs: dict | None) -> Node:
        top = self.stack[-1] if self.stack else None
        node = Node(len(self.nodes), top.pre if top else -1, len(self.stack), kind, tag, text, attrs,
                    top is not None and top.dropped or tag in _DROP)
        self.nodes.append(node)
        return node

    def flush(self, kind: str = "text") -> None:
        if not self.buf:
            return
        data, self.buf = "".join(self.buf), []
        if not self.preserved and not data.strip(ASCII_SPACES):
            data = "\n" if "\n" in data else " "
        if kind == "text" and self.hidden:
            kind = "other"
        node = self._add(kind, None, data, None)
        if self.items and not node.dropped:
            self.parts[-1].append(b"s" + hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest())

    def _count(self, tag: str, by: int) -> None:
        self.open[tag] = self.open.get(tag, 0) + by
        if tag == "li":
            self.items += by
        elif tag in PRESERVE_WS_TAGS:
            self.preserved += by
        elif tag in HIDDEN_STRING_TAGS:
            self.hidden += by

    def _close_top(self) -> None:
        node, parts = self.stack.pop(), self.parts.pop()
        if self.items and not node.dropped:  # list items are compared by their structure, nothing else is
            node.sig = _signature(node.tag, node.attrs, parts)
            if self.parts:
                self.parts[-1].append(b"e" + node.sig)
        self._count(node.tag, -1)
        node.last = len(self.nodes) - 1

    def _close(self, tag: str) -> None:
        self.flush()
        while self.open.get(tag) and self.stack:
            closed = self.stack[-1].tag
            self._close_top()
            if closed == tag:
                break

    # -- plain tags, without the parser's tolerant patterns ----------------
    def updatepos(self, i, j):
        return j  # line numbers are not asked for

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None or (tag := plain[1]) in _SPECIAL_TAGS:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, _PLAIN_ATTRIBUTE.findall(plain[2]) if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i)
        if plain is None or plain[1] in _SPECIAL_TAGS or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    # -- parser callbacks -----------------------------------------------
    def handle_starttag(self, tag, attrs, void=True):
        self.flush()
        self.stack.append(self._add("element", tag, None, {k: v or "" for k, v in attrs}))
        self.parts.append([])
        self._count(tag, 1)
        if void and tag in VOID_TAGS:
            self._close(tag)
            self.closed_void[tag] = self.closed_void.get(tag, 0) + 1  # a later end tag of this name is redundant

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, void=False)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.closed_void.get(tag, 0) > 0:
            self.closed_void[tag] -= 1
        else:
            self._close(tag)

    def handle_data(self, data):
        self.buf.append(data)

    def _special(self, data: str, kind: str) -> None:
        self.flush()
        self.buf.append(data)
        self.flush(kind)

    def handle_comment(self, data):
        self._special(data, "comment")

    def handle_decl(self, data):
        self._special(data, "other")

    def handle_pi(self, data):
        self._special(data, "other")

    def unknown_decl(self, data):
        cdata = data.upper().startswith("CDATA[")
        self._special(data[len("CDATA["):] if cdata else data, "text" if cdata else "other")

    def finish(self) -> list[Node]:
        self.close()
        self.flush()
        while self.stack:
            self._close_top()
        return self.nodes


def parse_html(html: str | None) -> tuple[list[Node], str | None]:
    """Nodes of one document, or what the parser had against it."""
    builder = _TreeBuilder()
    try:
        if html:
            builder.feed(html)
        return builder.finish(), None
    except (AssertionError, ValueError, IndexError) as why:  # how html.parser refuses markup
        return [], f"The markup could not be parsed: {why or type(why).__name__}"


# ---------------------------------------------------------------- one row per node
_NODE = pa.schema([
    pa.field("page_id", pa.int64()), pa.field("pre", pa.int32(), False), pa.field("last", pa.int32(), False),
    pa.field("parent", pa.int32(), False), pa.field("depth", pa.int32(), False), pa.field("kind", pa.string(), False),
    pa.field("tag", pa.string()), pa.field("text", pa.string()), pa.field("attrs", pa.map_(pa.string(), pa.string())),
    pa.field("dropped", pa.bool_(), False),
])
NODE_SCHEMA = ("page_id long, pre int, last int, parent int, depth int, kind string, tag string, text string, "
               "attrs map<string,string>, dropped boolean")
BATCH_NODES = 16_384


def _node_batches(batches):
    for batch in batches:
        for page_id, html in zip(batch.column(0), batch.column(1)):
            page_id = page_id.as_py()
            nodes, _ = parse_html(html.as_py())
            for at in range(0, len(nodes), BATCH_NODES):
                own = nodes[at:at + BATCH_NODES]
                columns = [[page_id] * len(own), *([getattr(n, k) for n in own] for k in ("pre", "last", "parent", "depth", "kind", "tag", "text")),
                           [None if n.attrs is None else list(n.attrs.items()) for n in own], [n.dropped for n in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE)


def page_nodes(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> one row per node, in the partition of its page (no shuffle)."""
    return pages.select("page_id", "html").mapInArrow(_node_batches, NODE_SCHEMA)


def drop_chrome(nodes: DataFrame) -> DataFrame:
    """Without the chrome tags and everything beneath them."""
    return nodes.filter(~F.col("dropped"))


# ---------------------------------------------------------------- one row per page
def _struct(**fields) -> pa.StructType:
    return pa.struct(list(fields.items()))


_I, _L, _S = pa.int32(), pa.int64(), pa.string()
_SLICE = {"first": _I, "n": _I}  # which of the page's visible strings stand under an element
_IMAGE = {"sources": pa.list_(_S), "alt": _S}
_KID = _struct(tag=_S, text=_S, href=_S, **_SLICE, **_IMAGE)
_BLOCK_ROW = _struct(pre=_I, tag=_S, **_SLICE, words=_L, text_len=_L, link_len=_L, kids=pa.list_(_KID), item_depth=_I, list_tag=_S,
                     ordinal=_I, list_start=_S, rows=pa.list_(pa.list_(_struct(**_SLICE))))
_MARKED = _struct(pre=_I, last=_I, tag=_S, role=_S, id=_S, classes=_S, text_len=_L, link_len=_L, p_words=_L)
_HOLDER = _struct(pre=_I, last=_I, text_len=_L, link_len=_L, kids=pa.list_(_struct(len=_L, commas=_L)), grandkids=pa.list_(_struct(len=_L, commas=_L)))
_TREE = {
    "parse_error": _S, "n_nodes": _L, "n_elements": _L, "n_text": _L, "max_depth": _I,
    "title_parts": pa.list_(_S), "metas": pa.list_(_struct(name=_S, property=_S, content=_S)), "times": pa.list_(_S),
    "strings": pa.list_(_S), "blocks": pa.list_(_BLOCK_ROW), "marked": pa.list_(_MARKED), "holders": pa.list_(_HOLDER),
    "whole": _MARKED,
}


class _Sums:
    """Subtree sums of an element: visible strings, link texts, words under paragraphs."""

    __slots__ = ("first", "n", "chars", "words", "commas", "link_chars", "links", "p_words")

    def __init__(self, first=0):
        self.first = first
        self.n = self.chars = self.words = self.commas = self.link_chars = self.links = self.p_words = 0

    def add(self, other: _Sums) -> None:
        self.n += other.n
        self.chars += other.chars
        self.words += other.words
        self.commas += other.commas
        self.link_chars += other.link_chars
        self.links += other.links
        self.p_words += other.p_words

    @property
    def text_len(self) -> int:
        """Length of the strings joined by a space."""
        return self.chars + max(self.n - 1, 0)

    @property
    def link_len(self) -> int:
        return self.link_chars + max(self.links - 1, 0)


def _image(attrs: dict) -> dict:
    return {"sources": [attrs.get(k) or "" for k in IMAGE_SOURCES], "alt": attrs.get("alt")}


_NO_IMAGE = {"sources": None, "alt": None}


def page_tree(nodes: list[Node]) -> dict:
    """The nested row of a page, in two linear passes over its nodes."""
    strings: list[str] = []
    sums: list[_Sums | None] = [None] * len(nodes)
    whole = _Sums()
    near: list[tuple] = [()] * len(nodes)  # of what stands under a node: nearest block, list, enclosing items
    emitted = bytearray(len(nodes))
    titles: list[str] | None = None
    title_end = -1
    for n in nodes:  # downwards
        up = nodes[n.parent] if n.parent >= 0 else None
        block, list_at, items = near[n.parent] if up else (None, -1, 0)
        if n.kind == "element":
            if n.tag == "title" and titles is None:
                titles, title_end = [], n.last
            if not n.dropped:
                sums[n.pre] = _Sums(len(strings))
                emitted[n.pre] = n.tag in _BLOCK and (block is None or n.tag != "img" and block in NEST_OK)
                near[n.pre] = (n.tag if n.tag in _BLOCK else block, n.pre if n.tag in ("ul", "ol") else list_at, items + (n.tag == "li"))
            else:
                near[n.pre] = (block, list_at, items)
        elif n.kind == "text" and (own := n.text.strip()):
            if n.pre <= title_end:
                titles.append(own)
            if not n.dropped:
                strings.append(own)
                to = sums[n.parent] if up else whole
                to.n, to.chars, to.words, to.commas = to.n + 1, to.chars + len(own), to.words + len(own.split()), to.commas + own.count(",")
    for n in reversed(nodes):  # upwards
        if (own := sums[n.pre]) is not None:
            to = sums[n.parent] if n.parent >= 0 else whole
            to.add(own)
            if n.tag == "a":
                to.link_chars, to.links = to.link_chars + own.text_len, to.links + 1
            elif n.tag == "p":
                to.p_words += own.words
    return {
        "n_nodes": len(nodes), "n_elements": sum(n.kind == "element" for n in nodes), "n_text": sum(n.kind == "text" for n in nodes),
        "max_depth": max((n.depth for n in nodes), default=None), "title_parts": titles,
        "metas": [{"name": n.attrs.get("name"), "property": n.attrs.get("property"), "content": n.attrs.get("content")} for n in nodes if n.tag == "meta"],
        "times": [n.attrs["datetime"] for n in nodes if n.tag == "time" and "datetime" in n.attrs],
        "strings": strings, "blocks": _blocks(nodes, sums, near, emitted),
        "marked": [_marked(n, sums[n.pre]) for n in nodes if sums[n.pre] is not None and (n.tag in ROOT_TAGS or not _PICKED.isdisjoint(n.attrs))],
        "holders": _holders(nodes, sums),
        "whole": {"pre": -1, "last": len(nodes) - 1, "tag": "[document]", "role": None, "id": None, "classes": None,
                  "text_len": whole.text_len, "link_len": whole.link_len, "p_words": whole.p_words},
    }


def _marked(n: Node, own: _Sums) -> dict:
    return {"pre": n.pre, "last": n.last, "tag": n.tag, "role": n.attrs.get("role"), "id": n.attrs.get("id"), "classes": n.attrs.get("class"),
            "text_len": own.text_len, "link_len": own.link_len, "p_words": own.p_words}


def _kid(n: Node, own: _Sums) -> dict:
    return {"tag": n.tag, "text": None, "href": n.attrs.get("href"), "first": own.first, "n": own.n,
            **(_image(n.attrs) if n.tag == "img" else _NO_IMAGE)}


def _blocks(nodes: list[Node], sums: list, near: list, emitted: bytearray) -> list[dict]:
    kids: dict[int, list[dict]] = {n.pre: [] for n in nodes if emitted[n.pre] and n.tag in _INLINE}
    items: dict[int, dict[bytes, int]] = {}  # of each list: the first place of each structure among its direct items
    counts: Counter[int] = Counter()
    tables = any(emitted[n.pre] and n.tag == "table" for n in nodes)
    rows = {tag: [n for n in nodes if n.tag in tag and sums[n.pre] is not None] if tables else [] for tag in (("tr",), ("th", "td"))}
    for n in nodes:
        if n.dropped:
            continue
        if n.parent in kids:
            if n.kind != "element":
                kids[n.parent].append({"tag": None, "text": n.text, "href": None, "first": 0, "n": 0, **_NO_IMAGE})
            else:
                kids[n.parent].append(_kid(n, sums[n.pre]))
        if n.tag == "li" and n.parent >= 0:
            counts[n.parent] += 1
            items.setdefault(n.parent, {}).setdefault(n.sig, counts[n.parent])

    def under(tags: tuple, n: Node) -> list[Node]:
        places = rows[tags]
        return places[bisect_left(places, n.pre + 1, key=lambda x: x.pre):bisect_right(places, n.last, key=lambda x: x.pre)]

    found = []
    for n in nodes:
        if not emitted[n.pre]:
            continue
        own = sums[n.pre]
        _, list_at, depth = near[n.parent] if n.parent >= 0 else (None, -1, 0)
        in_list = n.tag == "li" and list_at >= 0
        cells = [[{"first": sums[c.pre].first, "n": sums[c.pre].n} for c in under(("th", "td"), r)] for r in under(("tr",), n)] if n.tag == "table" else None
        found.append({
            "pre": n.pre, "tag": n.tag, "first": own.first, "n": own.n, "words": own.words, "text_len": own.text_len, "link_len": own.link_len,
            "kids": [_kid(n, own)] if n.tag == "img" else kids.get(n.pre), "item_depth": depth, "list_tag": nodes[list_at].tag if in_list else None,
            "ordinal": items.get(list_at, {}).get(n.sig, 1) if in_list else None, "list_start": nodes[list_at].attrs.get("start") if in_list else None,
            "rows": cells})
    return found


def _holders(nodes: list[Node], sums: list) -> list[dict]:
    """Parents and grandparents of paragraphs, with the paragraphs' measures."""
    found: dict[int, dict] = {}
    for n in nodes:
        own = sums[n.pre]
        if own is None or n.tag not in PARAGRAPH_TAGS or not own.n or n.parent < 0:
            continue
        for at, side in ((n.parent, "kids"), (nodes[n.parent].parent, "grandkids")):
            if at >= 0:
                found.setdefault(at, {"kids": [], "grandkids": []})[side].append({"len": own.text_len, "commas": own.commas})
    return [{"pre": at, "last": nodes[at].last, "text_len": sums[at].text_len, "link_len": sums[at].link_len, **sides} for at, sides in sorted(found.items())]


def _sql_type(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_sql_type(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"`{f.name}`:{_sql_type(f.type)}" for f in kind) + ">"
    return {_I: "int", _L: "bigint", _S: "string"}[kind]


def page_trees(pages: DataFrame, html: str = "html") -> DataFrame:
    """One nested row per page: the columns of ``pages`` but ``html``, and those of its tree."""
    names = [c for c in pages.columns if c != html]
    tree = pa.schema(list(_TREE.items()))

    def run(batches):
        for batch in batches:
            for part in parts_of(batch, html):
                rows = []
                for text in part.column(html):
                    nodes, error = parse_html(text.as_py())
                    rows.append({**page_tree(nodes), "parse_error": error})
                made = pa.RecordBatch.from_pylist(rows, schema=tree)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made.columns], [*names, *_TREE])

    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html]
    return pages.select(*names, html).mapInArrow(run, ", ".join([*given, *(f"`{k}` {_sql_type(t)}" for k, t in _TREE.items())]))
