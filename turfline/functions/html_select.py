"""Row generators by CSS selectors, table cells, links, calendars and class names, over stored HTML.

As in html_rows these are UDTFs over a projection of key and html; what follows them
(cleaning, teams, grouping) is done on DataFrames in operators.extraction.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .html_rows import HtmlForms, HtmlLeaves, HtmlMedia, HtmlTables, HtmlText, Node, tree
from .text import SCRIPT_TARGET

#: Attributes that hold a date, and patterns of class names of calendars.
DATE_ATTRIBUTES = ("data-date", "data-day", "data-timestamp", "datetime", "data-start", "data-event")
EVENT_CLASS = re.compile("fc-event|event-item|rdp-day", re.IGNORECASE)
TITLE_CLASS = re.compile("title|name|summary", re.IGNORECASE)

_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([~^$*]?)=[\"']?([^\"'\]]*)[\"']?)?\]")
_TESTS = {"": str.__eq__, "~": lambda have, want: want in have.split(), "^": str.startswith, "$": str.endswith, "*": str.__contains__}


def is_selector(text: str) -> bool:
    """Whether a text is a CSS selector rather than a plain class name."""
    return bool(re.search(r"[.#,\[\]>~+:]", text))


def _parsed(selector: str) -> list[tuple[str, list[tuple]]]:
    """Steps of a selector from left to right: the combinator before (" " or ">") and its simple tests."""
    steps, combinator = [], " "
    for part in re.sub(r"\s*>\s*", " > ", selector.strip()).split():
        if part == ">":
            combinator = ">"
            continue
        found = list(_SIMPLE.finditer(part))
        if "".join(m[0] for m in found) != part:
            raise ValueError(f"not in the supported subset of CSS: {selector}")
        steps.append((combinator, [m.groups() for m in found]))
        combinator = " "
    return steps


def _fits(node: Node, tests: list[tuple]) -> bool:
    for tag, name, cls, attr, how, value in tests:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if name and node.attrs.get("id") != name:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr and (attr not in node.attrs or (value is not None and not _TESTS[how or ""](node.attrs[attr], value))):
            return False
    return True


def _matches(node: Node, steps: list[tuple[str, list[tuple]]]) -> bool:
    combinator, tests = steps[-1]
    if not _fits(node, tests):
        return False
    if len(steps) == 1:
        return True
    above = node.parent
    while above is not None:
        if _matches(above, steps[:-1]):
            return True
        above = None if combinator == ">" else above.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Elements of a selector in page order; without any, once more without tbody, which sources often leave out."""
    steps = _parsed(selector)
    found = [n for n in root.walk() if n.parent and _matches(n, steps)]
    bare = re.sub(r"\s*>?\s*\btbody\b\s*>?\s*", " ", selector, flags=re.IGNORECASE).strip()
    return found if found or not bare or bare == selector else select(root, bare)


def link_of(node: Node) -> str:
    """The link of an element: its own, that of the first anchor inside, or of one of five elements around."""
    inside = next((n for n in node.walk() if n.tag == "a" and _address(n)), None)
    above, steps = node.parent, 0
    while inside is None and above is not None and steps < 5:
        inside = above if above.tag == "a" and _address(above) else None
        above, steps = above.parent, steps + 1
    return _address(inside) if inside else ""


def _address(node: Node) -> str:
    """A link's target; scripted ones name it in onclick."""
    href = node.attrs.get("href", "").strip()
    if href and not href.lower().startswith(("javascript:", "#")):
        return href
    scripted = re.search(SCRIPT_TARGET, node.attrs.get("onclick", ""), re.IGNORECASE)
    return scripted[1].strip() if scripted else ""


def _row_of(node: Node) -> Node | None:
    while node is not None and node.tag != "tr":
        node = node.parent
    return node


class HtmlSelect:
    """group, position, column, value, href of the elements of comma-separated selectors, or of a class name.

    Elements in one table row share a group; "Label : value" pairs outside of tables are
    group -1, the page's card; any other element is a group of its own.
    """

    def eval(self, html: str, selectors: str):
        root = tree(html)
        number = {id(n): i for i, n in enumerate(root.walk())}
        wanted = [s.strip() for s in selectors.split(",") if s.strip()] if is_selector(selectors) else ["." + ".".join(selectors.split())]
        position = 0
        for selector in wanted:
            for node in select(root, selector):
                text, row = node.text(), _row_of(node)
                if not text:
                    continue
                strong = next((c.text() for c in node.walk() if c.tag in ("strong", "b")), "")
                group = number[id(row)] if row else number[id(node)]
                if strong.rstrip().endswith(":") and text.startswith(strong):
                    group, column, text = (group if row else -1), strong.rstrip(": "), text[len(strong) :].strip()
                elif "label" in node.attrs.get("class", "").split():
                    continue
                else:
                    last = selector.split()[-1]
                    column = last.strip(".#") if re.fullmatch(r"[.#][\w-]+", last) else node.attrs.get("data-label") or node.attrs.get("aria-label") or next(iter(node.attrs.get("class", "").split()), node.tag)
                yield group, position, column, text, link_of(node)
                position += 1


def _tagged(root: Node, tag: str) -> list[Node]:
    """The elements of a tag in page order, without a generator's cost for each node."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            out.append(node)
        if node.children:
            todo += node.children[::-1]
    return out


class HtmlTableRows:
    """table, row, row_class, columns, values, hrefs of every data row, cell by cell; header rows are left out."""

    def eval(self, html: str):
        for t, table in enumerate(_tagged(tree(html), "table")):
            rows = _tagged(table, "tr")
            head = next((r for r in rows if any(c.tag == "th" for c in r.children)), None)
            names = [" ".join(c.text().split()) for c in head.children if c.tag in ("th", "td")] if head else []
            for r, row in enumerate(rows):
                cells = [c for c in row.children if c.tag in ("th", "td")]
                if not cells or (cells[0].tag == "th" and all(c.tag == "th" for c in cells)) or (row.parent and row.parent.tag == "thead"):
                    continue
                columns, values, hrefs = names[: len(cells)], [], []
                for i, cell in enumerate(cells):
                    if i >= len(columns):
                        columns.append("")
                    if not columns[i]:
                        columns[i] = " ".join((cell.attrs.get("data-label") or f"col_{i}").split())
                    link = next((n for n in cell.walk() if n.tag == "a"), None) if cell.children else None
                    values.append(cell.text() or (link.attrs.get("title", "") if link else ""))
                    hrefs.append(_address(link) if link else "")
                yield t, r, row.attrs.get("class", ""), columns, values, hrefs


class HtmlCells:
    """table, row, row_class, position, column, value, href of every data cell; header rows are left out."""

    def eval(self, html: str):
        for t, r, row_class, *cells in HtmlTableRows().eval(html):
            for i, (column, value, href) in enumerate(zip(*cells, strict=True)):
                yield t, r, row_class, i, column, value, href


class HtmlLinks:
    """position, text, href of anchors with any quoting, of elements with data-href; bare "#" is no link."""

    def eval(self, html: str):
        position = 0
        for n in tree(html).walk():
            for href in (n.attrs.get("href", "") if n.tag == "a" else "", n.attrs.get("data-href", "")):
                if href.strip() and href.strip() != "#":
                    yield position, n.text(), href.strip()
                    position += 1


class HtmlCalendar:
    """kind, tag, title, date, source of events by class, by date attribute and by time element."""

    def eval(self, html: str):
        nodes = [n for n in tree(html).walk() if n.parent]
        first = lambda n: next((n.attrs[a] for a in DATE_ATTRIBUTES if n.attrs.get(a)), "")
        title = lambda n: next((c.text() for c in n.walk() if c is not n and TITLE_CLASS.search(c.attrs.get("class", ""))), n.text())
        for n in nodes:
            if EVENT_CLASS.search(n.attrs.get("class", "")):
                yield "calendar_event", n.tag, title(n), first(n), "class-pattern"
        for a in DATE_ATTRIBUTES:
            for n in nodes:
                if n.attrs.get(a):
                    yield "calendar_event", n.tag, title(n), first(n), f"attr:{a}"
        for n in nodes:
            if n.tag == "time":
                yield "calendar_time", n.tag, n.text(), n.attrs.get("datetime", ""), "time"


class HtmlClassNames:
    """class, position, sample: every class of every element in page order, with the element's text."""

    def eval(self, html: str):
        for i, n in enumerate(tree(html).walk()):
            for c in n.attrs.get("class", "").split():
                yield c, i, n.text()


#: The ordered registry of general generators, each over html alone.
EXTRACTORS: dict[str, tuple[type, tuple]] = {
    "html_tables": (HtmlTables, ()),
    "html_links": (HtmlLinks, ()),
    "html_forms": (HtmlForms, ()),
    "html_media": (HtmlMedia, ()),
    "html_calendar": (HtmlCalendar, ()),
    "html_leaves": (HtmlLeaves, (1 << 30,)),
    "html_text": (HtmlText, ()),
}


class HtmlExtract:
    """extractor, position, row (JSON), error: all generators in order; one that fails is an error row and the others go on."""

    def eval(self, html: str):
        for name, (generator, more) in EXTRACTORS.items():
            try:
                for i, row in enumerate(generator().eval(html, *more)):
                    yield name, i, json.dumps(row, ensure_ascii=False), None
            except Exception as failed:  # noqa: BLE001  (told in the row)
                yield name, -1, None, f"{type(failed).__name__}: {failed}"


GENERATORS = {
    "html_select": (HtmlSelect, "group int, position int, column string, value string, href string"),
    "html_table_rows": (HtmlTableRows, "table int, row int, row_class string, columns array<string>, values array<string>, hrefs array<string>"),
    "html_cells": (HtmlCells, "table int, row int, row_class string, position int, column string, value string, href string"),
    "html_links": (HtmlLinks, "position int, text string, href string"),
    "html_calendar": (HtmlCalendar, "kind string, tag string, title string, date string, source string"),
    "html_class_names": (HtmlClassNames, "class string, position int, sample string"),
    "html_extract": (HtmlExtract, "extractor string, position int, row string, error string"),
}


def register(spark: SparkSession) -> None:
    for name, (cls, returns) in GENERATORS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=returns))


def rows_of(generator: type, html: str, *args: object) -> Iterator[tuple]:
    """A generator's rows outside of Spark, for tests."""
    return iter(generator().eval(html, *args))
