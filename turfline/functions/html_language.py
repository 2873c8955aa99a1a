"""The language that a page's tree tells of one of its elements.

Evidence is searched by distance: the element's own attributes, flags inside it, flags right
before and right after it, then what its ancestors declare, at last the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .html_rows import Node

#: Language codes and their English names.
LANGUAGES = {
    "fr": "french", "en": "english", "de": "german", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "ru": "russian", "ja": "japanese", "zh": "chinese",
    "ko": "korean", "ar": "arabic", "pl": "polish", "tr": "turkish", "vi": "vietnamese", "id": "indonesian", "th": "thai", "he": "hebrew", "sv": "swedish", "no": "norwegian",
    "da": "danish", "fi": "finnish", "cs": "czech", "hu": "hungarian", "ro": "romanian", "uk": "ukrainian", "el": "greek", "hi": "hindi", "bn": "bengali",
}
#: Country codes and the language of their flag.
COUNTRIES = {
    "fr": "fr", "be": "fr", "qc": "fr", "gb": "en", "uk": "en", "us": "en", "ca": "en", "au": "en", "ie": "en", "nz": "en", "de": "de", "at": "de", "ch": "de",
    "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "ru": "ru", "jp": "ja", "cn": "zh", "tw": "zh", "hk": "zh", "kr": "ko",
    "sa": "ar", "eg": "ar", "ae": "ar", "pl": "pl", "tr": "tr", "vn": "vi", "id": "id", "th": "th", "il": "he", "se": "sv", "dk": "da", "fi": "fi", "cz": "cs", "hu": "hu", "ro": "ro",
    "ua": "uk", "gr": "el", "in": "hi",
}
#: Names of countries and languages in a flag's description.
COUNTRY_NAMES = {
    "france": "fr", "french": "fr", "français": "fr", "francais": "fr", "england": "en", "english": "en", "anglais": "en", "uk": "en", "britain": "en", "american": "en", "america": "en",
    "germany": "de", "german": "de", "allemand": "de", "deutsch": "de", "spain": "es", "spanish": "es", "espagnol": "es", "italy": "it", "italian": "it", "italien": "it",
    "portugal": "pt", "portuguese": "pt", "portugais": "pt", "brazil": "pt", "netherlands": "nl", "dutch": "nl", "néerlandais": "nl", "neerlandais": "nl",
    "russia": "ru", "russian": "ru", "russe": "ru", "japan": "ja", "japanese": "ja", "japonais": "ja", "china": "zh", "chinese": "zh", "chinois": "zh",
    "korea": "ko", "korean": "ko", "coréen": "ko", "coreen": "ko", "poland": "pl", "polish": "pl", "polonais": "pl", "turkey": "tr", "turkish": "tr", "turc": "tr",
    "vietnam": "vi", "vietnamese": "vi", "vietnamien": "vi", "indonesia": "id", "indonesian": "id", "thailand": "th", "thai": "th", "israel": "he", "hebrew": "he", "hébreu": "he", "hebreu": "he",
    "sweden": "sv", "swedish": "sv", "suédois": "sv", "suedois": "sv", "denmark": "da", "danish": "da", "danois": "da", "finland": "fi", "finnish": "fi", "finlandais": "fi",
    "arabia": "ar", "arabic": "ar", "arabe": "ar",
}
#: Attributes that name an element's language, and words by which a description is that of a flag.
OWN_ATTRIBUTES = ("hreflang", "data-lang", "data-locale", "data-language", "lang")
FLAG_WORDS = ("flag", "drapeau", "langue", "language", "lang", "country")
#: Codes in class names and in names of picture files.
_CLASS_CODES = (
    re.compile(r"\b(?:flag|fi|lang|locale|country|lng)(?:[-_][a-z]+)*[-_](?P<code>[a-z]{2})(?:[-_][a-z]{2})?\b", re.IGNORECASE),
    re.compile(r"\b(?:flag|icon|country|lang|locale)\s+(?P<code>[a-z]{2})\b", re.IGNORECASE),
)
_FILE_CODE = re.compile(r"(?:flag|flags?|country|lang|locale)[\-_/]?(?P<code>[a-z]{2})\.(?:png|svg|gif|jpe?g|webp)", re.IGNORECASE)

_BY_NAME = {name: code for code, name in LANGUAGES.items()}
_WORDS = re.compile(r"\w+")


def declared_code(value: str) -> str:
    """ "fr-FR" or "en_US" to its language; other codes of two or three letters stay, anything else is ""."""
    code = re.split("[-_]", value.strip().lower())[0]
    if not re.fullmatch("[a-z]{2,3}", code):
        return ""
    return code if code in LANGUAGES else COUNTRIES.get(code, code)


def _flag_code(code: str) -> str:
    return code if code in LANGUAGES else COUNTRIES.get(code, "")


def described_code(text: str) -> str:
    """The language in a picture's description: a code, a language's name, or a country's in a short or flag-like text."""
    told = text.strip().lower()
    if re.fullmatch(r"[^\W\d_]{2,3}", told) and (code := _flag_code(told)):
        return code
    if re.fullmatch("[a-z]{2,3}[-_][a-z]{2,3}", told):
        return declared_code(told)
    words = _WORDS.findall(told)
    order = list(_BY_NAME)
    named = min((w for w in words if w in _BY_NAME), key=order.index, default=None)
    if named:
        return _BY_NAME[named]
    if len(told) <= 30 or any(w in told for w in FLAG_WORDS):
        order = list(COUNTRY_NAMES)
        named = min((w for w in words if w in COUNTRY_NAMES), key=order.index, default=None)
    return COUNTRY_NAMES[named] if named else ""


def flag_language(node: Node) -> str:
    """The language of an element that is a flag by its file, its description or its class; "" for any other."""
    if node.tag == "img":
        file = _FILE_CODE.search(node.attrs.get("src", ""))
        if file:
            return _flag_code(file["code"].lower())
        if code := described_code(node.attrs.get("alt", "") + " " + node.attrs.get("title", "")):
            return code
    for pattern in _CLASS_CODES:
        if found := pattern.search(" ".join(node.attrs.get("class", "").split())):
            return _flag_code(found["code"].lower())
    return ""


def _flags_inside(node: Node, most: int) -> Iterator[Node]:
    return islice((n for n in node.walk() if n is not node and n.tag in ("img", "i", "span")), most)


def near_language(node: Node) -> str:
    """By the element's own attribute, then flags among the first five pictures and spans inside, then those beside it."""
    for name in OWN_ATTRIBUTES:
        if node.attrs.get(name):
            return declared_code(node.attrs[name])
    near = list(_flags_inside(node, 5))
    if node.parent:
        around = node.parent.children
        at = next(i for i, n in enumerate(around) if n is node)
        for beside in [*around[max(0, at - 1) : at], *around[at + 1 : at + 2]]:
            near += [beside, *_flags_inside(beside, 3)]
    return next(filter(None, map(flag_language, near)), "")


def inherited_language(node: Node) -> str:
    """What the element or the nearest ancestor declares."""
    above: Node | None = node
    while above is not None:
        for name in ("lang", "xml:lang"):
            if above.attrs.get(name):
                return declared_code(above.attrs[name])
        above = above.parent
    return ""


def page_declaration(root: Node) -> str:
    """What the page declares in <html> or in one of three meta forms."""
    nodes = list(root.walk())
    page = next((n for n in nodes if n.tag == "html"), None)
    told = page and (page.attrs.get("lang") or page.attrs.get("xml:lang"))
    for name, wanted in (("http-equiv", "content-language"), ("name", r"^language$"), ("property", r"og:locale$")):
        told = told or next((n.attrs["content"] for n in nodes if n.tag == "meta" and n.attrs.get("content") and re.search(wanted, n.attrs.get(name, ""), re.IGNORECASE)), "")
    return declared_code(told or "")


def element_language(node: Node, page: str = "") -> str:
    """The nearest evidence of all; `page` is what the page declares."""
    return near_language(node) or inherited_language(node) or page
