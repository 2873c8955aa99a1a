"""Row generators over stored HTML: Python UDTFs on the standard library's parser.

Register them with register(spark) and call them with LATERAL, always over a projection of
key and html alone, after the filters.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .html_language import element_language, page_declaration

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p span li td th dt dd blockquote figcaption label strong em b i small".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.texts: list[str | Node] = []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            if node.children:
                todo.extend(node.children[::-1])

    def text(self) -> str:
        texts = self.texts
        if len(texts) == 1 and isinstance(texts[0], str) and self.tag not in ("script", "style"):
            return " ".join(texts[0].split())
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.texts and x.tag not in ("script", "style"):
                todo.extend(x.texts[::-1])
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.at.texts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.texts.append(data)


#: Markup that needs no parser's care: lower-case tags, double-quoted or bare attributes, no references, comments or stray signs.
_ATTRIBUTES = r'((?: +[a-z][a-z0-9:_-]*(?:="[^"&<>]*")?+)*+)'
_PLAIN = re.compile(rf"(?:[^<&]++|</[a-z][a-z0-9]*+>|<[a-z][a-z0-9]*+{_ATTRIBUTES} *+>)*+")
_TOKENS = re.compile(rf"([^<]*+)(?:<(/?)([a-z][a-z0-9]*+){_ATTRIBUTES} *+>)?")
_PAIRS = re.compile(r'([a-z][a-z0-9:_-]*+)(?:="([^"]*)")?')
#: Elements whose content is no markup; a text area without content is as any other.
_RAW = re.compile(r"<(?:script|style|title|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math|textarea(?![^>]*></textarea>))[ >]")


@lru_cache(4096)
def _attributes(text: str) -> dict[str, str]:
    """The attributes of a start tag; equal ones share their dict, which nobody changes."""
    return dict(_PAIRS.findall(text))


_NONE: dict[str, str] = {}


def _plain_tree(html: str) -> Node:
    """The tree of markup that _PLAIN takes whole, as _Tree builds it, in a quarter of its time."""
    root = at = Node("#root", {}, None)
    for text, end, tag, attributes in _TOKENS.findall(html):
        if text:
            at.texts.append(text)
        if end:
            if at.tag == tag and at.parent:
                at = at.parent
                continue
            node: Node | None = at
            while node and node.tag != tag:
                node = node.parent
            if node and node.parent:
                at = node.parent
        elif tag:
            node = Node(tag, _attributes(attributes) if attributes else _NONE, at)
            at.children.append(node)
            at.texts.append(node)
            if tag not in _VOID:
                at = node
    return root


def tree(html: str | None) -> Node:
    if html and _PLAIN.fullmatch(html) and not _RAW.search(html):
        return _plain_tree(html)
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _ordered(node: Node, tags: set[str] | frozenset[str]) -> list[Node]:
    return [n for n in node.walk() if n.tag in tags]


class HtmlTables:
    """table, row, cells (JSON by header, or col_i)."""

    def eval(self, html: str):
        for t, table in enumerate(_ordered(tree(html), {"table"})):
            header: list[str] = []
            r = 0
            for tr in _ordered(table, {"tr"}):
                heads = [c.text() for c in tr.children if c.tag == "th"]
                cells = [c.text() for c in tr.children if c.tag == "td"]
                if heads and not cells:
                    header = heads
                elif cells:
                    yield t, r, json.dumps({header[i] if i < len(header) and header[i] else f"col_{i}": c for i, c in enumerate(cells)}, ensure_ascii=False)
                    r += 1


class HtmlText:
    """position, tag, text, attributes of the text-bearing elements."""

    def eval(self, html: str):
        for i, n in enumerate(x for x in _ordered(tree(html), _TEXT) if x.text()):
            yield i, n.tag, n.text(), " ".join(f"{k}={v}" for k, v in sorted(n.attrs.items()))


class HtmlForms:
    """form, field, type, name, value; options of a select one by one."""

    def eval(self, html: str):
        for f, form in enumerate(_ordered(tree(html), {"form"})):
            for n in form.walk():
                if n.tag in ("input", "button"):
                    yield f, n.tag, n.attrs.get("type", "text" if n.tag == "input" else "submit"), n.attrs.get("name", ""), n.attrs.get("value", n.text())
                elif n.tag == "textarea":
                    yield f, n.tag, "text", n.attrs.get("name", ""), n.text()
                elif n.tag == "select":
                    for o in _ordered(n, {"option"}):
                        yield f, n.tag, "option", n.attrs.get("name", ""), o.attrs.get("value", o.text())


class HtmlMedia:
    """kind, src of images (lazy ones too), source sets, video, audio and frames."""

    def eval(self, html: str):
        for n in tree(html).walk():
            if n.tag == "img":
                src = next((n.attrs[a] for a in ("src", "data-src", "data-lazy-src", "data-original") if n.attrs.get(a)), "")
                if src:
                    yield "img", src
            if n.tag in ("img", "source") and n.attrs.get("srcset"):
                for part in n.attrs["srcset"].split(","):
                    if part.split():
                        yield "srcset", part.split()[0]
            elif n.tag in ("video", "audio", "iframe", "source") and n.attrs.get("src"):
                yield n.tag, n.attrs["src"]


def _cell_header(node: Node) -> str:
    """The header over the table cell that a node lies in: the cell of the same place in the first row with a th."""
    cell = next((n for n in _upwards(node) if n.tag == "td"), None)
    row = cell.parent if cell else None
    if row is None or row.tag != "tr":
        return ""
    at = next(i for i, c in enumerate(c for c in row.children if c.tag in ("td", "th")) if c is cell)
    table = next((n for n in _upwards(row) if n.tag == "table"), None)
    heads = next(([c.text() for c in r.children if c.tag in ("td", "th")] for r in _ordered(table, {"tr"}) if any(c.tag == "th" for c in r.children)), []) if table else []
    return heads[at] if at < len(heads) else ""


def _upwards(node: Node, most: int = 1 << 30) -> Iterator[Node]:
    """The node and its ancestors, at most so many of these."""
    at: Node | None = node
    while at is not None and most >= 0:
        yield at
        at, most = at.parent, most - 1


#: Classes that only lay a page out, by prefix and whole.
LAYOUT_PREFIXES = (
    "col-", "row-", "container", "btn", "mb-", "mt-", "ml-", "mr-", "mx-", "my-", "p-", "pt-", "pb-", "pl-", "pr-", "px-", "py-",
    "d-", "flex-", "justify-", "align-", "items-", "self-", "order-", "text-", "font-", "fs-", "fw-", "bg-", "border", "rounded",
    "shadow", "w-", "h-", "min-", "max-", "gap-", "space-", "absolute", "relative", "fixed", "sticky", "static", "z-",
    "overflow", "cursor-", "opacity-", "hidden", "visible", "block", "inline", "grid", "table-", "list-", "truncate",
)
LAYOUT_CLASSES = ("row", "col", "container", "small", "lead", "show", "hide")


def column_of(node: Node, labels: dict[str, str]) -> str:
    """What a leaf's column is called: by the header over its cell, a label for it or around it, a labelling attribute near it, a telling class near it, or its tag."""
    label = labels.get(node.attrs.get("id", ""), "") or next((n.text() for n in list(_upwards(node, 3))[1:] if n.tag == "label"), "")
    attribute = next((v for n in _upwards(node, 4) for a in ("data-label", "aria-label", "data-column") if (v := n.attrs.get(a))), "")
    telling = (c for n in _upwards(node, 4) for c in n.attrs.get("class", "").split() if len(c) >= 3 and c not in LAYOUT_CLASSES and not c.startswith(LAYOUT_PREFIXES))
    name = _cell_header(node) or label or attribute or next(telling, "") or node.tag
    return " ".join(name.split())[:80]


class HtmlLeaves:
    """column, value, language of every leaf down to a depth; a value "Label : text" is its own column (see column_of and html_language)."""

    def eval(self, html: str, depth: int):
        root = tree(html)
        page = page_declaration(root)
        labels = {n.attrs["for"]: n.text() for n in root.walk() if n.tag == "label" and n.attrs.get("for")}
        stack = [(root, 0)]
        while stack:
            node, at = stack.pop()
            if at > depth:
                continue
            inner = [c for c in node.children if c.tag not in ("script", "style", "br", "b", "i", "em", "strong", "sup")]
            if not inner and node.parent and (value := node.text()):
                strong = next((c.text() for c in node.children if c.tag == "strong"), "")
                paired = ":" in strong and value.startswith(strong)
                column, value = (strong.rstrip(": "), value[len(strong) :].lstrip(":- ")) if paired else (column_of(node, labels), value)
                yield column, value, element_language(node, page)
            stack.extend((c, at + 1) for c in reversed(inner))


class HtmlClasses:
    """parent_class, instance, child_class: the classes inside every element that has at least two elements with classes in it."""

    def eval(self, html: str):
        count: dict[str, int] = {}
        named = lambda n: [c for c in n.attrs.get("class", "").split() if len(c) > 1 and "[" not in c]
        for n in tree(html).walk():
            own = named(n)
            inner = [x for x in n.walk() if x is not n and "class" in x.attrs] if own else []
            if len(inner) < 2:
                continue
            inside = sorted({c for x in inner for c in named(x)})
            for name in own:
                k = count[name] = count.get(name, -1) + 1
                for c in inside:
                    if c != name:
                        yield name, k, c


GENERATORS = {
    "html_tables": (HtmlTables, "table int, row int, cells string"),
    "html_text": (HtmlText, "position int, tag string, text string, attributes string"),
    "html_forms": (HtmlForms, "form int, field string, type string, name string, value string"),
    "html_media": (HtmlMedia, "kind string, src string"),
    "html_leaves": (HtmlLeaves, "column string, value string, language string"),
    "html_classes": (HtmlClasses, "parent_class string, instance int, child_class string"),
}


def register(spark: SparkSession) -> None:
    for name, (cls, returns) in GENERATORS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=returns))


def fingerprint(html: str | None, depth: int = 4, most: int = 2000) -> str:
    """SHA-1 of the sorted tag paths of the body, each with its first class; 2000 paths at most are the feature's bound."""
    body = next((n for n in tree(html).walk() if n.tag == "body"), None)
    paths, todo = [], [(body, "", 0)] if body else []
    while todo and len(paths) < most:
        node, path, at = todo.pop()
        first = next(iter(node.attrs.get("class", "").split()), "")
        here = f"{path}/{node.tag}{'.' + first if first else ''}"
        paths.append(here)
        if at < depth:
            todo.extend((c, here, at + 1) for c in reversed(node.children))
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


def dom_fingerprint() -> object:
    """A vectorised UDF from html to its skeleton's digest."""

    @F.pandas_udf("string")
    def digest(html: pd.Series) -> pd.Series:
        return html.map(fingerprint)

    return digest


def visible_text() -> object:
    """A vectorised UDF from html to its whole text without scripts and styles."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(lambda x: tree(x).text() if x else "")

    return text


def absolute_url() -> object:
    """A vectorised UDF that resolves a link against its page."""

    @F.pandas_udf("string")
    def join(base: pd.Series, link: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b or "", x or "") for b, x in zip(base, link, strict=True)])

    return join
