"""Row generators whose rows carry what surrounds an element: controls with their labels, anchors with calendar headings and language, and what a page offers for selection.

As in html_rows these are UDTFs over a projection of key and html. They gather evidence; which
kind a control is, which heading counts and which class is worth a selector is decided by
expressions in operators.controls.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .html_language import inherited_language, near_language, page_declaration
from .html_rows import Node, tree

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Classes of blocks that label a control, of menus, and of a site's navigation.
LABEL_CLASS = re.compile(r"\b(card-header|card-title|form-label|field-label|input-label|control-label|field-title|legend|col-form-label)\b", re.IGNORECASE)
MENU_CLASS = re.compile(r"\b(dropdown-menu|menu-list|select-dropdown|options-list)\b", re.IGNORECASE)
NAVIGATION = re.compile(r"\b(nav|navbar|header|topbar|site-?menu|main-?menu|primary-?menu)\b", re.IGNORECASE)
#: Classes of a menu's chosen entry, types of inputs that nobody fills in, classes of tables that tell nothing.
CHOSEN_CLASS = re.compile(r"\b(active|selected|current|default|tous|all)\b", re.IGNORECASE)
NOT_FILLED = frozenset("submit button reset hidden image file".split())
PLAIN_TABLE = frozenset("table tbody thead fallback-table".split())
LAYOUT_PREFIXES = ("mt-", "mb-", "p-", "d-", "w-", "h-")


def _above(node: Node, most: int) -> Iterator[Node]:
    """The nearest ancestors, at most so many; the document itself is the last."""
    at = node.parent
    while at is not None and most > 0:
        yield at
        at, most = at.parent, most - 1


def _before(node: Node) -> list[Node]:
    """Earlier sibling elements, the nearest first."""
    around = node.parent.children if node.parent else []
    at = next((i for i, n in enumerate(around) if n is node), 0)
    return around[:at][::-1]


def _classes(node: Node) -> str:
    return " ".join(node.attrs.get("class", "").split())


def selector_of(node: Node) -> str:
    """A readable selector: tag, id, up to two classes, name."""
    parts = [node.tag, f"#{node.attrs['id']}" if node.attrs.get("id") else "", *[f".{c}" for c in node.attrs.get("class", "").split()[:2]]]
    return "".join(parts) + (f'[name="{node.attrs["name"]}"]' if node.attrs.get("name") else "")


class _Labels:
    """What labels a control, by where it stands."""

    def __init__(self, root: Node):
        self.by_id: dict[str, str] = {}
        for n in root.walk():
            if n.tag == "label" and n.attrs.get("for"):
                self.by_id.setdefault(n.attrs["for"], n.text())

    def of(self, node: Node) -> tuple[str, str, str, str, str]:
        """By id; around it (three ancestors); before it, under 80 characters; its own attributes; a title in one of four ancestors."""
        around = next((t for n in _above(node, 3) if n.tag == "label" and (t := n.text())), "")
        before = next((n.text() for n in _before(node) if n.tag in ("label", "span")), "")
        own = next((v for a in ("aria-label", "title", "data-label") if (v := node.attrs.get(a, "").strip())), "")
        return self.by_id.get(node.attrs.get("id", ""), ""), around, before if len(before) < 80 else "", own[:80], self._title(node)

    @staticmethod
    def _title(node: Node) -> str:
        path = {id(node)}
        for above in _above(node, 4):
            if above.tag not in ("body", "html", "main"):
                for child in above.children:
                    titled = child.tag in _HEADINGS or child.tag == "legend" or LABEL_CLASS.search(_classes(child))
                    if titled and id(child) not in path and 2 <= len(text := child.text()) <= 80:
                        return text
            path.add(id(above))
        return ""


def _option(node: Node) -> tuple[str, str]:
    """(value attribute, label); a following option that lies inside for want of an end tag is no part of the label."""
    parts, todo = [], list(reversed(node.texts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag != "option":
            todo.extend(reversed(x.texts))
    return node.attrs.get("value", ""), " ".join(" ".join(parts).split())


def _menu_of(toggle: Node) -> Node | None:
    """The menu that a toggle opens: right after it, else beside it, else in its parent, else in its grandparent."""
    is_menu = lambda n: bool(MENU_CLASS.search(_classes(n)))
    up = list(_above(toggle, 2))
    if not up:
        return None
    around = up[0].children
    at = next(i for i, n in enumerate(around) if n is toggle)
    places = [around[at + 1 : at + 2], [n for n in around if n is not toggle], *[[n for n in a.walk() if n is not a and n is not toggle] for a in up]]
    return next((n for place in places for n in place if is_menu(n)), None)


class HtmlControls:
    """The controls of a page with the evidence of what they are.

    form (-1 outside of forms), action, method, position, tag (input, select, textarea or dropdown),
    type, role, name, value, placeholder, selector, the five labels of _Labels, in_navigation, and options.
    """

    def eval(self, html: str):
        root = tree(html)
        labels = _Labels(root)
        nodes = list(root.walk())
        forms = [n for n in nodes if n.tag == "form"]
        number = {id(n): i for i, n in enumerate(forms)}
        form_of = lambda n: next((a for a in _above(n, len(nodes)) if a.tag == "form"), None)
        in_navigation = lambda n: any(x.tag == "nav" or NAVIGATION.search(_classes(x)) or NAVIGATION.search(x.attrs.get("id", "")) for x in [n, *_above(n, 7)])
        position = 0
        for n in nodes:
            if n.tag not in ("input", "select", "textarea") or (n.tag == "input" and n.attrs.get("type", "text").lower() in NOT_FILLED):
                continue
            form = form_of(n)
            where = (number[id(form)], form.attrs.get("action", ""), (form.attrs.get("method") or "GET").upper()) if form else (-1, "", "")
            options = [_option(o) for o in n.walk() if o.tag == "option"] if n.tag == "select" else []
            kind = (n.attrs.get("type") or "text").lower() if n.tag == "input" else ""
            told = (n.attrs.get("role", "").lower(), n.attrs.get("name", ""), n.attrs.get("value", "") if n.tag == "input" else "", n.attrs.get("placeholder", ""), selector_of(n))
            yield (*where, position, n.tag, kind, *told, *labels.of(n), bool(in_navigation(n)), options)
            position += 1
        for attribute in ("data-toggle", "data-bs-toggle"):
            for n in nodes:
                if n.tag in ("button", "a", "div", "span") and n.attrs.get(attribute, "").lower() == "dropdown" and (menu := _menu_of(n)):
                    entries = [a for a in menu.walk() if a.tag == "a" and a.text()]
                    own = next((v for a in ("aria-label", "title", "data-label", "data-original-title") if (v := n.attrs.get(a, "").strip())), "")
                    chosen = next((a.text() for a in entries if CHOSEN_CLASS.search(_classes(a))), "")
                    options = [(a.attrs.get("href", ""), a.text()) for a in entries]
                    yield -1, "", "", position, "dropdown", "", "", "", "", "", selector_of(n), n.text(), "", "", own, chosen, bool(in_navigation(n)), options
                    position += 1


class HtmlSubmits:
    """What the forms of a page send: form, action, method, position (in the order of sending), name, fixed (a hidden input's value), default (null: not sent unless asked for), and whether it shows dates day first.

    Inputs come first, then selects, then text areas; buttons and files send nothing.
    """

    def eval(self, html: str):
        for f, form in enumerate(n for n in tree(html).walk() if n.tag == "form"):
            inside, position = list(form.walk()), 0
            for n in sorted((n for n in inside if n.tag in ("input", "select", "textarea") and n.attrs.get("name")), key=lambda n: ("input", "select", "textarea").index(n.tag)):
                kind = (n.attrs.get("type") or "text").lower()
                if n.tag == "input" and kind in NOT_FILLED - {"hidden"}:
                    continue
                yield f, form.attrs.get("action", ""), (form.attrs.get("method") or "GET").upper(), position, n.attrs["name"], n.tag == "input" and kind == "hidden", _default(n, kind), _day_first(n)
                position += 1


#: How an input shows that it takes days first.
_DAY_FIRST, _DAY_HINT = re.compile(r"\d{2}/\d{2}/\d{4}"), re.compile("(DD|JJ|dd|jj)/(MM|mm)")


def _day_first(node: Node) -> bool:
    shown = " ".join(node.attrs.get(a, "") for a in ("placeholder", "pattern", "title"))
    return node.tag == "input" and bool(_DAY_FIRST.fullmatch(node.attrs.get("value", "").strip()) or _DAY_HINT.search(shown))


def _default(node: Node, kind: str) -> str | None:
    """What a control sends untouched: a hidden value always, a box that is checked, a value that is not empty, the chosen or first option."""
    if node.tag == "select":
        options = [o for o in node.walk() if o.tag == "option"]
        chosen = next((o for o in options if "selected" in o.attrs), next(iter(options), None))
        return None if chosen is None else chosen.attrs["value"] if "value" in chosen.attrs else _option(chosen)[1]
    if node.tag == "textarea":
        return None
    if kind in ("checkbox", "radio"):
        return (node.attrs.get("value") or "on") if "checked" in node.attrs else None
    return node.attrs.get("value", "") or ("" if kind == "hidden" else None)


class HtmlAnchors:
    """The anchors of a page with what surrounds them.

    position, text, href, onclick, cell (whether in a table cell), headings of its table (where each
    stands, and its text, the nearest first), and its language: near, inherited and the page's.
    """

    def eval(self, html: str):
        root = tree(html)
        page = page_declaration(root)
        headings: dict[int, list[tuple[str, str]]] = {}
        for position, n in enumerate(x for x in root.walk() if x.tag == "a"):
            up = list(_above(n, 1 << 30))
            cell = any(x.tag == "td" for x in up)
            table = next((x for x in up if x.tag == "table"), None) if cell else None
            if table is not None and id(table) not in headings:
                headings[id(table)] = list(_table_headings(table))
            yield position, n.text(), n.attrs.get("href", "").strip(), n.attrs.get("onclick", ""), cell, headings.get(id(table), []), near_language(n), inherited_language(n), page


def _table_headings(table: Node) -> Iterator[tuple[str, str]]:
    """What may name a table: its caption, header cells, up to four earlier siblings, headings right in up to three ancestors."""
    inside = list(table.walk())
    yield from (("caption", t) for n in inside if n.tag == "caption" and (t := n.text()))
    yield from (("head", t) for head in inside if head.tag == "thead" for n in head.walk() if n.tag == "th" and (t := n.text()))
    for n in _before(table)[:4]:
        text = n.text()
        if text and (n.tag in _HEADINGS or (n.tag in ("div", "span", "p") and len(text) <= 40)):
            yield "sibling", text
    for above in _above(table, 3):
        yield from (("ancestor", t) for n in above.children if n.tag in _HEADINGS and (t := n.text()))


class HtmlMenus:
    """menu, position, label, href: the entries of every dropdown menu of a page."""

    def eval(self, html: str):
        entry = lambda n: n.tag == "a" and "dropdown-item" in n.attrs.get("class", "").split()
        for m, menu in enumerate(n for n in tree(html).walk() if n.tag == "div" and "dropdown-menu" in n.attrs.get("class", "").split()):
            for i, n in enumerate(x for x in menu.walk() if entry(x)):
                yield m, i, n.text(), n.attrs.get("href", "")


class HtmlTargets:
    """kind, number, selector, name, position, sample: data rows of tables that have an id or a telling class, and cells by class that hold a link."""

    def eval(self, html: str):
        nodes = list(tree(html).walk())
        for t, table in enumerate(n for n in nodes if n.tag == "table"):
            telling = [c for c in table.attrs.get("class", "").split() if len(c) >= 3 and c not in PLAIN_TABLE and not c.startswith(LAYOUT_PREFIXES)]
            name = table.attrs.get("id") or next(iter(telling), "")
            if not name:
                continue
            selector = f"#{name} tr" if table.attrs.get("id") else f"table.{name} tr"
            rows = [n for n in table.walk() if n.tag == "tr" and not any(a.tag == "thead" for a in _within(n, table))]
            for i, row in enumerate(rows):
                yield "table", t, selector, name, i, row.text()
        for i, n in enumerate(nodes):
            if "class" in n.attrs and n.tag in ("td", "li", "div", "span") and any(x.tag == "a" and x.attrs.get("href") for x in _first_anchor(n)):
                for c in n.attrs.get("class", "").split():
                    if len(c) >= 2 and "[" not in c and "]" not in c:
                        yield "calendar", -1, f".{c}", c, i, n.text()


def _within(node: Node, top: Node) -> Iterator[Node]:
    at = node.parent
    while at is not None and at is not top:
        yield at
        at = at.parent


def _first_anchor(node: Node) -> list[Node]:
    return [a] if (a := next((x for x in node.walk() if x is not node and x.tag == "a"), None)) else []


GENERATORS = {
    "html_controls": (
        HtmlControls,
        "form int, action string, method string, position int, tag string, type string, role string, name string, value string, placeholder string, selector string, "
        "label_by_id string, label_around string, label_before string, label_own string, label_title string, in_navigation boolean, options array<struct<value: string, label: string>>",
    ),
    "html_submits": (HtmlSubmits, "form int, action string, method string, position int, name string, fixed boolean, default string, day_first boolean"),
    "html_anchors": (
        HtmlAnchors,
        "position int, text string, href string, onclick string, cell boolean, headings array<struct<place: string, text: string>>, near string, inherited string, declared string",
    ),
    "html_menus": (HtmlMenus, "menu int, position int, label string, href string"),
    "html_targets": (HtmlTargets, "kind string, number int, selector string, name string, position int, sample string"),
}


def register(spark: SparkSession) -> None:
    for name, (cls, returns) in GENERATORS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=returns))
