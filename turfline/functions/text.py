"""Scalar expressions over names, labels, scores, dates and URLs; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a missing value in assembled rows.
MISSING = "NONE"

#: Keywords that mark the level of an event, the first hit counts.
LEVEL_KEYWORDS = [
    (("elite",), "Elite"),
    (("pro",), "Pro"),
    (("national", "chp de france", "championnat"), "National"),
    (("regional", "circuit reg"), "Regional"),
    (("coupe",), "Coupe"),
    (("poney 3", "club 3"), "Niveau3"),
    (("poney 2", "club 2"), "Niveau2"),
    (("poney 1", "club 1"), "Niveau1"),
    (("as poney",), "As"),
    (("benjamin",), "Benjamin"),
    (("moustique",), "Moustique"),
    (("poussin",), "Poussin"),
    (("minime",), "Minime"),
    (("cadet",), "Cadet"),
]
DEFAULT_LEVEL = "Club"
#: Keywords that mark the kind of an event, the first hit counts.
KIND_KEYWORDS = [
    (("grand prix",), "GrandPrix"),
    (("vitesse",), "Vitesse"),
    (("mania",), "Mania"),
    (("carrousel",), "Carrousel"),
    (("tda",), "TDA"),
    (("equipe", "mixte", "feminine"), "Equipe"),
    (("trec",), "TREC"),
]
DEFAULT_KIND = "Autre"
#: The rank of a level, others 3.
LEVEL_ORDINALS = {
    "Moustique": 1, "Poussin": 1, "Benjamin": 2, "Minime": 2, "Cadet": 3, "Club": 3, "Niveau1": 3, "Niveau2": 4,
    "Niveau3": 4, "As": 4, "Regional": 5, "Coupe": 5, "National": 6, "Pro": 7, "Elite": 8,
}
#: Markers of client-rendered pages.
SCRIPTED_MARKERS = ["window.__NEXT_DATA__", "window.__NUXT__", '<div id="root"></div>', '<div id="app"></div>', "ng-version=", "__vue_app__", "data-reactroot"]
#: Month names in French and English.
MONTHS = {
    "janvier": 1, "january": 1, "février": 2, "fevrier": 2, "february": 2, "mars": 3, "march": 3, "avril": 4, "april": 4,
    "mai": 5, "may": 5, "juin": 6, "june": 6, "juillet": 7, "july": 7, "août": 8, "aout": 8, "august": 8,
    "septembre": 9, "september": 9, "octobre": 10, "october": 10, "novembre": 11, "november": 11,
    "décembre": 12, "decembre": 12, "december": 12,
}


def strip(x: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def name_key(x: Column) -> Column:
    return F.upper(strip(x))


def height_cm(x: Column) -> Column:
    """The first number before "cm" in any case, else 0."""
    return F.coalesce(F.regexp_extract(x, r"(?i)(\d+)\s*cm", 1).try_cast("int"), F.lit(0))


def event_family(x: Column) -> Column:
    """The label up to its height (lower-case cm only) or a "(+n)" suffix; blank is Autre."""
    cut = strip(F.regexp_replace(strip(x), r"(?s)\d+\s*cm.*", ""))
    cut = strip(F.regexp_replace(cut, r"(?s)\s*\(\+\d+\).*", ""))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(DEFAULT_KIND))


def keyword_case(x: Column, cascade: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """The value of the first entry one of whose keywords the text holds; order matters."""
    low = F.lower(x)
    out = F.lit(default)
    for words, value in reversed(cascade):
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def event_level(x: Column) -> Column:
    return keyword_case(x, LEVEL_KEYWORDS, DEFAULT_LEVEL)


def event_kind(x: Column) -> Column:
    return keyword_case(x, KIND_KEYWORDS, DEFAULT_KIND)


def level_ordinal(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in LEVEL_ORDINALS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, x), F.lit(3))


def is_team(x: Column) -> Column:
    """0 for INDIVIDUEL in any case, 1 for anything else and for null."""
    return F.when(name_key(x) == "INDIVIDUEL", 0).otherwise(1)


def first_value(*candidates: Column) -> Column:
    """The first candidate that is neither null, blank nor the missing text, else the missing text."""
    return F.coalesce(*[F.when((strip(c) != "") & (name_key(c) != MISSING), strip(c)) for c in candidates], F.lit(MISSING))


def has_value(x: Column) -> Column:
    """Neither null, blank, the missing text nor -1."""
    return F.coalesce(~name_key(x.cast("string")).isin("", MISSING, "-1"), F.lit(False))


def outcome(rank: Column, points: Column, strict_reference: bool = False) -> Column:
    """1 for a rank of 1 to 3 or at least 8 points. strict_reference also counts ranks below 1."""
    good = (rank <= 3) if strict_reference else rank.between(1, 3)
    return F.when(good | (points >= 8), 1).otherwise(0)


def field_size_bin(n: Column) -> Column:
    return F.when((n > 0) & (n <= 10), "small").when((n > 10) & (n <= 25), "medium").when((n > 25) & (n <= 50), "large").when((n > 50) & (n <= 999), "xlarge").otherwise("nan")


def verdict(score: Column, cold: Column | None = None) -> Column:
    """favori from 60, outsider+ from 35, outsider below, inconnu without score; cold-start overrides."""
    out = F.when(score.isNull(), "inconnu").when(score >= 60, "favori").when(score >= 35, "outsider+").otherwise("outsider")
    return out if cold is None else F.when(cold, "cold-start").otherwise(out)


def pseudo_age(starts: Column) -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(12), F.when(starts == 0, 3).otherwise(starts)))


def percent_score(x: Column) -> Column:
    """Text with "%" or comma decimals to 0..100, half-even; 0..1 counts as a share; no number is null."""
    value = F.replace(F.regexp_replace(strip(x), r"%+$", ""), F.lit(","), F.lit("."))
    value = strip(value).try_cast("double")
    whole = F.bround(F.when(value.between(0, 1), value * 100).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))).cast("int")
    return F.when(value.isNotNull(), whole)


def bounded_int(x: Column, low: int, high: int) -> Column:
    """Text to a whole number within bounds, else null."""
    value = F.regexp_extract(strip(x), r"^(\d{1,9})", 1).try_cast("int")
    return F.when(value.between(low, high), value)


#: Patterns of ordinals, of elimination, of absence and of ranking column names.
_ORDINAL = r"(?iU)^\s*(\d+)\s*(?:er|ère|ere|re|nd|nde|ème|eme|e)(?:\s*(?:ex\.?|ex\s*aequo|ex\s*æquo))?\s*\.?\s*$"
_ELIMINATED = r"(?iU)^(?:el|eli|elim|élim|eliminé|éliminé|elimine|disq|dsq|dq|abandon|abd|nc|np)(?:\.|\s|$)"
_ABSENT = r"(?iU)^(?:non[\s\-]*partant\b|forfait\b|hors[\s\-]*concours\b|fft\b|hc\b|(?:[ée]preuve\s+)?annul(?:é|ée|ee|e)\b)"
_RANKING_NAME = r"(?iU)\b(?:clt|classement|class|rang|place|quart|pts|points?|score|note)\b"


def clean_ordinal(x: Column) -> Column:
    """"1 er" to "1", markers of elimination to "-1", others unchanged."""
    s = strip(x)
    return F.when(s.rlike(_ELIMINATED), "-1").when(s.rlike(_ORDINAL), F.regexp_extract(s, _ORDINAL, 1)).otherwise(x)


def ranking_number(x: Column) -> Column:
    """In a ranking column, text that is no number is -1; blank stays."""
    s = strip(x)
    return F.when(s == "", x).when(s.rlike(r"^-?\d+(?:\.\d+)?$"), s).otherwise("-1")


def is_ranking_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(_RANKING_NAME)


def did_not_start(x: Column) -> Column:
    return F.coalesce(strip(x).rlike(_ABSENT), F.lit(False))


def date_to_iso(x: Column) -> Column:
    """DD/MM/YYYY or ISO text to ISO text, null for other text."""
    s = strip(x)
    day = F.coalesce(F.try_to_date(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s), "yyyy-MM-dd"), F.try_to_date(F.when(s.rlike(r"^\d{2}/\d{2}/\d{4}$"), s), "dd/MM/yyyy"))
    return F.date_format(day, "yyyy-MM-dd")


def month_heading(x: Column) -> Column:
    """A heading such as "Avril 2026" or "2026 April" to "2026-04", else null."""
    names = "|".join(MONTHS)
    number = F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair])
    both = []
    for pattern, name, year in ((rf"(?iU)\b({names})\b[\s,]*\b(20\d\d|19\d\d)\b", 1, 2), (rf"(?iU)\b(20\d\d|19\d\d)\b[\s,]*\b({names})\b", 2, 1)):
        month = F.try_element_at(number, F.lower(F.regexp_extract(x, pattern, name)))
        both.append(F.when(month.isNotNull(), F.format_string("%s-%02d", F.regexp_extract(x, pattern, year), month)))
    return F.coalesce(*both)


def calendar_day(heading: Column, day: Column) -> Column:
    """A month heading and a day of 1 to 31 to an ISO date text; the month's length is not checked."""
    n = F.when(strip(day).rlike(r"^\d{1,2}$"), strip(day)).try_cast("int")
    return F.when(n.between(1, 31), F.concat(month_heading(heading), F.lit("-"), F.lpad(n.cast("string"), 2, "0")))


def query_value(url: Column, key: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def url_template(url: Column) -> Column:
    """scheme://host/path with id-like segments as :id and query keys sorted with :val; "" without a host."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]+)", 1)
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://", 1))
    path = F.regexp_extract(url, r"^[^?#]*?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    # Fixed value: what counts as an id in a path.
    id_like = r"^(?:\d+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[\w-]{8,}-\d+)$"
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(id_like), ":id").otherwise(s))
    keys = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda c: c != ""), lambda c: F.split(c, "=")[0])))
    tail = F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("=:val"))), "&"))).otherwise("")
    return F.when(F.coalesce(host, F.lit("")) == "", "").otherwise(F.concat(scheme, F.lit("://"), host, F.lit("/"), F.array_join(parts, "/"), tail))


def url_with_filters(url: Column, values: Column) -> Column:
    """A URL with a map of filter values: links among them move it, in their order, and all others become its parameters.

    A link starts with http:// or https:// (the whole URL), "/" (path and query) or "?" (query); a fragment
    stays where only a part is replaced. A parameter takes the place of all those of its name; others stay as they
    are, repeated ones too. Blank values count for nothing.
    """
    given = F.filter(F.map_entries(F.transform_values(values, lambda k, v: strip(v))), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    is_link = lambda v: v.rlike("^(https?://|/|[?])")

    def moved(at: Column, v: Column) -> Column:
        site, fragment = F.regexp_extract(at, r"^([a-zA-Z][\w+.-]*://[^/?#]*)?", 0), F.regexp_extract(at, "#.*$", 0)
        path = F.regexp_extract(at, r"^((?:[a-zA-Z][\w+.-]*://[^/?#]*)?[^?#]*)", 1)
        query = F.regexp_replace(v, r"^\?+", "")
        asked = F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), fragment)
        return F.when(v.rlike("^https?://"), v).when(v.startswith("?"), asked).otherwise(F.concat(site, v, fragment))

    base = F.aggregate(F.filter(given, lambda e: is_link(e["value"])), url, lambda at, e: moved(at, e["value"]))
    plain = F.filter(given, lambda e: ~is_link(e["value"]))
    names = F.transform(plain, lambda e: F.url_encode(e["key"]))
    name_of = lambda p: F.regexp_replace(F.regexp_extract(p, "^[^=]*", 0), "%20", "+")
    held = F.filter(F.split(F.regexp_extract(base, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.array_contains(names, name_of(p)))
    query = F.array_join(F.concat(held, F.transform(plain, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))), "&")
    return F.when(F.size(plain) == 0, base).otherwise(F.concat(F.regexp_extract(base, "^[^?#]*", 0), F.lit("?"), query, F.regexp_extract(base, "#.*$", 0)))


def slug(x: Column, length: int = 60) -> Column:
    """Lower case, no scheme, runs of other than word characters as one "_", none at the ends, cut."""
    s = F.regexp_replace(F.lower(x), r"^https?://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w]+", "_"), "_+", "_")
    return F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, length)


#: Fixed value: where a script names the address that it loads.
SCRIPT_TARGET = r"""url\s*:\s*['"]([^'"]+)['"]"""


def onclick_url(x: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(x, f"(?i){SCRIPT_TARGET}", 1)), F.lit(""))


def is_scripted_page(html: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in SCRIPTED_MARKERS]), lambda m: F.contains(html, m))


def language_code(x: Column, known: tuple[str, ...], countries: dict[str, str]) -> Column:
    """"fr-FR" or "en_US" to the language; a country code to its language; other 2-3 letters stay; else ""."""
    code = F.split(F.lower(strip(x)), "[-_]")[0]
    mapped = F.create_map(*[F.lit(v) for pair in countries.items() for v in pair])
    return F.when(~F.coalesce(code, F.lit("")).rlike("^[a-z]{2,3}$"), "").when(code.isin(*known), code).otherwise(F.coalesce(F.try_element_at(mapped, code), code))
