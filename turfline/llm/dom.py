"""HTML pages as flat arrays of block elements with their text runs.

Only block elements become nodes; inline elements pass their text to the block around
them. A node's text between two child blocks is a run, and runs are the blocks of
the extracted text. A run right under the root gets a node of its own, so that it is
judged like a block. Elements that never show text (scripts, styles, the head, form
controls) are skipped whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Block elements of HTML, elements without visible text, and which open elements a start tag closes.
BLOCKS = frozenset(
    "html body main article section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre address figure figcaption details summary hgroup hr center dialog menu search".split()
)
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button title datalist".split())
TO_THE_END = frozenset("script style noscript iframe textarea title".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: The tag of a run's own node right under the root.
TEXT = "#text"
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
#: A start tag closes such elements only inside the nearest of these.
SCOPES = frozenset("ul ol dl table html body".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass
class Page:
    """Node i's parent comes before it; node 0 is the root, which has no runs itself."""

    tags: list[str] = field(default_factory=lambda: ["body"])
    attributes: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    links: list[int] = field(default_factory=lambda: [0])
    inputs: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str | None) -> Page:
    page = Page()
    html = html or ""
    stack: list[int] = [0]
    text: list[str] = []
    in_link, link_chars = 0, 0

    def add(tag: str, attributes: str) -> int:
        page.tags.append(tag)
        page.attributes.append(attributes)
        page.parents.append(stack[-1])
        page.links.append(0)
        page.inputs.append(0)
        return len(page.tags) - 1

    def flush() -> None:
        nonlocal link_chars
        if text:
            if run := " ".join("".join(text).split()):
                node = stack[-1] or add(TEXT, "")
                page.runs.append((node, run))
                page.links[node] += link_chars
            text.clear()
        link_chars = 0

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                piece = unescape(piece) if "&" in piece else piece
                text.append(piece)
                if in_link:
                    link_chars += len(piece)
            continue
        name = name.lower()
        if m[1] or m[4]:  # an end tag
            if name == "a":
                in_link = 0
            elif name in BLOCKS:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if page.tags[stack[d]] == name), 0)
                if depth:
                    close_to(depth)
                elif name not in ("body", "html"):
                    flush()
            continue
        rest = m[3] if m[2] else m[6]
        if name in SKIPPED:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if not rest.endswith("/"):  # without an end tag these hold the rest of the page
                at = close.end() if close else end if name in TO_THE_END else at
            if name in ("select", "textarea", "button"):
                page.inputs[stack[-1]] += 1
            continue
        if name == "br":
            text.append(" ")
        elif name == "input":
            page.inputs[stack[-1]] += 1
        elif name == "a":
            in_link = 1
        elif name in BLOCKS:
            flush()
            in_link = 0
            if name in ("html", "body"):
                page.attributes[0] = f"{page.attributes[0]} {_tokens(rest)}".strip()
                continue
            if name in VOID:
                continue
            if page.tags[stack[-1]] == "p":
                del stack[-1]
            for d in range(len(stack) - 1, 0, -1):
                tag = page.tags[stack[d]]
                if tag in CLOSES.get(name, ()):
                    del stack[d:]
                    if name not in ("tbody", "tfoot", "tr"):
                        break
                elif tag in SCOPES:
                    break
            stack.append(add(name, _tokens(rest)))
    flush()
    return page


def _tokens(rest: str) -> str:
    """The words of the telling attributes, lower case; "hidden" for what is not displayed."""
    if not rest.strip(" /"):
        return ""
    out = []
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden")
        elif name in ("hidden", "aria-hidden"):
            if value != "false":
                out.append("hidden")
        else:
            out.append(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower())
    return " ".join(out)
