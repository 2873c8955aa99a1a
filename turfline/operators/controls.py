"""Decisions over the evidence of html_context: fields and filters of a page, enriched rows, targets worth a selector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html_rows
from ..functions import text as t

#: Names and hints of search boxes, names of date fields, placeholders that only show a date's form.
SEARCH_HINT = r"(?i)search|recherche|query|\bq\b|keyword|filter"
DATE_NAME = r"(?i)^(deb(ut)?|fin|date(_(debut|fin|de|depart|arriv[ée]e))?|du|au|start|end|from|to)$"
DATE_PLACEHOLDER = r"(?i)^(jj/mm/aaaa|dd/mm/yyyy|mm/dd/yyyy|yyyy-mm-dd|aaaa-mm-jj)$"
#: Fewer links are a menu, not a filter; so many labels tell two dropdowns apart; lengths of labels and names.
LEAST_OPTIONS, TOLD_BY, LABEL_LENGTH, NAME_LENGTH = 5, 10, 60, 40
#: Rows of a table and cells of a class from which they are worth a selector, and samples and their lengths in a report.
LEAST_TARGETS = {"table": 2, "calendar": 3}
SAMPLES = {"table": (5, 120), "calendar": (10, 60)}


def _evidence() -> list[tuple[str, int, Column]]:
    """(kind, weight, whether it holds): the kind with the most weight wins. An input's type outweighs its name."""
    c = F.col
    inside = c("form") >= 0
    return [
        ("checkbox", 8, c("type") == "checkbox"),
        ("radio", 8, c("type") == "radio"),
        ("date", 8, c("type") == "date"),
        ("date", 4, inside & (c("tag") == "input") & c("name").rlike(DATE_NAME)),
        ("search", 2, c("type") == "search"),
        ("search", 2, ~inside & (c("role") == "searchbox")),
        ("search", 1, (c("tag") == "input") & c("name").rlike(SEARCH_HINT)),
        ("search", 1, ~inside & (c("tag") == "input") & c("placeholder").rlike(SEARCH_HINT)),
        ("select", 8, c("tag").isin("select", "dropdown")),
        ("text", 0, c("tag").isin("input", "textarea")),
    ]


def _first_told(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in texts], F.lit(""))


def detected_fields(controls: DataFrame, key: str) -> DataFrame:
    """The fillable fields of every page, from html_controls: key, area, form, action, method, position, kind, score, name, label, value, placeholder, selector, options.

    The area is form, filter (a select, date or dropdown outside of forms) or search (an input outside of
    forms that asks for words); other inputs outside are left out. Every kind's evidence is added up;
    score is the winner's. A label is the nearest of: by id, around, before, own, a title above, the
    placeholder. A dropdown has LEAST_OPTIONS links or more, lies outside of the navigation, and
    counts once a page.
    """
    c = F.col
    evidence = _evidence()
    kinds = list(dict.fromkeys(k for k, _, _ in evidence))
    total = lambda kind: sum((F.when(F.coalesce(holds, F.lit(False)), weight).otherwise(0) for k, weight, holds in evidence if k == kind), F.lit(0))
    # The greatest total, and of equal ones the kind named first.
    best = F.array_max(F.array(*[F.struct(total(k).alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(kinds) if k != "text"]))
    rows = controls.withColumn("_best", best)
    rows = rows.withColumn("kind", F.when(c("_best.score") > 0, c("_best.kind")).otherwise("text")).withColumn("score", c("_best.score").cast("int"))
    outside = F.when(c("kind").isin("select", "date"), "filter").when(c("kind") == "search", "search")
    rows = rows.withColumn("area", F.when(c("form") >= 0, "form").otherwise(outside)).where(c("area").isNotNull())
    is_menu = c("tag") == "dropdown"
    rows = rows.where(~is_menu | (~c("in_navigation") & (F.size("options") >= LEAST_OPTIONS)))
    told = F.array_join(F.transform(F.slice("options", 1, TOLD_BY), lambda o: o["label"]), "|")
    same = Window.partitionBy(key, F.when(is_menu, told).otherwise(c("position").cast("string")), is_menu).orderBy("position")
    rows = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")

    shown = F.when(~F.trim("placeholder").rlike(DATE_PLACEHOLDER), F.substring(F.trim("placeholder"), 1, 80)).otherwise("")
    near = _first_told(c("label_by_id"), c("label_around"), c("label_before"), c("label_own"), c("label_title"), shown)
    menu_label = F.substring(_first_told(c("label_by_id"), c("label_own"), c("label_title"), c("options")[0]["label"]), 1, LABEL_LENGTH)
    label = (
        F.when(is_menu, menu_label)
        .when(c("area") == "search", _first_told(near, c("placeholder"), c("name"), F.lit("recherche")))
        .when(c("tag") == "input", _first_told(near, F.when(c("area") == "form", c("placeholder")), c("name"), F.when(c("area") == "filter", F.lit("date"))))
        .when(c("area") == "filter", _first_told(near, c("name"), F.lit("filtre")))
        .otherwise(_first_told(near, c("name")))
    )
    rows = rows.withColumn("label", label)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, NAME_LENGTH)
    name = F.when(is_menu, _first_told(slug, F.lit("dropdown"))).otherwise(c("name"))
    # In a form the value is what is sent; elsewhere the label, which stays the same from page to page.
    option = lambda o: F.struct(F.when(c("area") == "form", _first_told(o["value"], o["label"])).otherwise(_first_told(o["label"], F.when(~is_menu, o["value"]))).alias("value"), o["label"].alias("label"))
    return rows.select(key, "area", "form", "action", "method", "position", "kind", "score", name.alias("name"), "label", "value", "placeholder", "selector", F.transform("options", option).alias("options"))


def merged_filters(fields: DataFrame, key: str) -> DataFrame:
    """key, area, form, name, kind, label, controls, options: one filter per form and name; equally named boxes or radio buttons are its options."""
    choice = F.col("kind").isin("checkbox", "radio")
    own = F.when(choice, F.array(F.struct(_first_told(F.col("value"), F.lit("on")).alias("value"), F.col("label").alias("label")))).otherwise(F.col("options"))
    # Nameless controls stay apart.
    group = F.when(F.col("name") == "", F.concat(F.lit("#"), F.col("position"))).otherwise(F.col("name"))
    named = fields.withColumn("_group", group).withColumn("_options", own)
    merged = named.groupBy(key, "area", "form", "_group").agg(
        F.min_by(F.struct("name", "kind", "label"), "position").alias("_first"),
        F.count(F.lit(1)).alias("controls"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "_options"))), lambda x: x["_options"])).alias("options"),
        F.min("position").alias("position"),
    )
    return merged.select(key, "area", "form", "position", "_first.*", "controls", "options")


def form_descriptors(fields: DataFrame, key: str) -> DataFrame:
    """key, form, action, method, fields: every form that has a field, with its fields in page order."""
    one = F.struct("position", "kind", "score", "name", "label", "placeholder", "selector", "options")
    return fields.where("area = 'form'").groupBy(key, "form", "action", "method").agg(F.array_sort(F.collect_list(one)).alias("fields"))


def current_values(submits: DataFrame, key: str) -> DataFrame:
    """key, name, value: what the first control of each name holds; "" if that is nothing."""
    return submits.groupBy(key, "name").agg(F.coalesce(F.min_by("default", F.struct("form", "position")), F.lit("")).alias("value"))


#: Actions that mean the page itself.
OWN_PAGE = ("", "-", "?")


def submissions(submits: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """key, form, score, method, target, body, url: what is sent for a set of values, by the form that takes most of them.

    submits: rows of html_submits. asked: key, page_url and `values` (a map of names to texts). A form's score is how
    many of its controls ask for a value that is not empty; the first of the best counts, and pages whose
    forms take none give no row. Hidden values are sent as they are, others as asked or by default; of controls of one
    name the last counts, in the place of the first; an ISO date is turned round for a control that shows days first. `url` is the target with the body as its query for GET.
    """
    c = F.col
    given = c("values")[c("name")]
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    wanted = F.when(c("day_first") & given.rlike(iso), F.regexp_replace(given, iso, "$3/$2/$1")).otherwise(given)
    rows = submits.join(asked.select(key, "page_url", "values"), key)
    rows = rows.withColumn("_hit", F.coalesce(wanted != "", F.lit(False)).cast("int"))
    scores = rows.groupBy(key, "form").agg(F.sum("_hit").alias("score")).where("score > 0")
    best = scores.groupBy(key).agg(F.max_by("form", F.struct("score", -F.col("form"))).alias("form"), F.max("score").alias("score"))
    sent = rows.join(best, [key, "form"]).withColumn("_value", F.when(c("fixed"), c("default")).otherwise(F.coalesce(wanted, c("default"))))
    of_name = sent.groupBy(key, "form", "score", "action", "method", "page_url", "name").agg(
        F.min(F.when(c("_value").isNotNull(), c("position"))).alias("place"), F.max_by("_value", F.when(c("_value").isNotNull(), c("position"))).alias("value")
    )
    pair = F.when(c("place").isNotNull(), F.struct("place", F.concat(F.url_encode("name"), F.lit("="), F.url_encode("value")).alias("pair")))
    whole = of_name.groupBy(key, "form", "score", "action", "method", "page_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["pair"]), "&").alias("body"))
    action = t.strip(c("action"))
    whole = whole.withColumn("target", F.when(action.isin(*OWN_PAGE), c("page_url")).otherwise(html_rows.absolute_url()("page_url", action)))
    bare = F.regexp_replace("target", r"[?#].*$", "")
    return whole.select(key, "form", "score", "method", "target", "body", F.when(c("method") == "GET", F.concat(bare, F.when(c("body") != "", F.concat(F.lit("?"), "body")).otherwise(""))).otherwise(c("target")).alias("url"))


def calendar_date(text: Column, cell: Column, headings: Column) -> Column:
    """The ISO date of a calendar's cell: a text of 1 to 31 under the nearest heading that holds a month and a year."""
    month = F.filter(F.transform(headings, lambda h: t.month_heading(h["text"])), lambda m: m.isNotNull())
    day = F.when(t.strip(text).rlike(r"^\d+$"), t.strip(text)).try_cast("int")
    return F.when(cell & day.between(1, 31), F.concat(F.try_element_at(month, F.lit(1)), F.lit("-"), F.lpad(day.cast("string"), 2, "0")))


def calendar_cells(anchors: DataFrame, key: str) -> DataFrame:
    """key, position, day, href, place, date: anchors in table cells whose text is a day under a heading with a month; from html_anchors."""
    named = F.filter("headings", lambda h: t.month_heading(h["text"]).isNotNull())
    rows = anchors.withColumn("date", calendar_date(F.col("text"), F.col("cell"), F.col("headings"))).where("date IS NOT NULL")
    return rows.select(key, "position", t.strip(F.col("text")).cast("int").alias("day"), "href", F.try_element_at(named, F.lit(1))["place"].alias("place"), "date")


def anchor_language(known: Column | None = None) -> Column:
    """The nearest evidence of html_anchors; `known` replaces what the page declares."""
    return _first_told(F.col("near"), F.col("inherited"), known if known is not None else F.col("declared"))


def enriched_rows(rows: DataFrame, anchors: DataFrame, key: str, step: str) -> DataFrame:
    """rows (key, row, text, href) with step_id, the target of a scripted link, the calendar date and the language.

    rows meet the anchors of their page: by text for script and date, by href for the language; the
    first anchor that answers counts. A row without an own link takes the script's. anchors are read three times: staged
    ones spare a page from being parsed as often.
    """
    text = t.strip(F.col("text"))
    scripted = F.lower(F.coalesce("href", F.lit(""))).startswith("javascript") | (F.coalesce("href", F.lit("")) == "")
    told = anchors.withColumns({"_target": t.onclick_url(F.col("onclick")), "_date": calendar_date(F.col("text"), F.col("cell"), F.col("headings")), "_language": anchor_language()})
    by_text = told.where(text != "").groupBy(key, text.alias("_text")).agg(F.min_by("_target", F.when(F.col("_target").isNotNull(), F.col("position"))).alias("_target"), F.min_by("_date", F.when(F.col("_date").isNotNull(), F.col("position"))).alias("_date"))
    by_href = told.where("href <> ''").groupBy(F.col(key).alias("_key"), F.col("href").alias("_href")).agg(F.min_by("_language", "position").alias("_language"))
    pages = told.groupBy(key).agg(F.first("declared").alias("_page"))
    out = rows.withColumn("_text", text).join(by_text, [key, "_text"], "left").join(pages, key, "left")
    out = out.join(by_href, (F.col(key) == F.col("_key")) & (F.col("href") == F.col("_href")), "left")
    link = F.when(scripted & F.col("_target").isNotNull(), F.col("_target")).otherwise(F.col("href"))
    return out.select(*rows.columns[: rows.columns.index("href")], link.alias("href"), F.lit(step).alias("step_id"), F.coalesce("_date", F.lit("")).alias("date"), _first_told(F.col("_language"), F.col("_page")).alias("language"))


#: How the first entry of a calendar's menus begins, and what stands for a menu that no page gives.
MENU_KINDS = {"region": "toutes régions", "departement": "tous départements", "discipline": "toutes disciplines", "championnat": "championnats"}
FALLBACK_LABELS = {"region": ("Toutes régions",), "departement": ("Tous départements",), "championnat": ("Championnats : tous concours",)}


def calendar_menus(menus: DataFrame, pages: DataFrame, key: str, disciplines: tuple[str, ...]) -> DataFrame:
    """key, kind, options (label and absolute url), selected, degraded: the four menus of every page, from html_menus.

    A menu's kind is told by its first entry; of several of a kind the last counts. Pages without any such menu get
    fallback entries that lead to the page itself, and are marked. pages: key, page_url.
    """
    told = F.lower("label")
    kind = F.coalesce(*[F.when(told.startswith(begin), k) for k, begin in MENU_KINDS.items()])
    heads = menus.where("position = 0").withColumn("kind", kind).where("kind IS NOT NULL")
    chosen = heads.groupBy(key, "kind").agg(F.max("menu").alias("menu"))
    found = menus.join(chosen, [key, "menu"]).join(pages.select(key, "page_url"), key).withColumn("url", html_rows.absolute_url()("page_url", "href"))
    entries = found.groupBy(key, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "label", "url"))), lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url"))).alias("options"))
    labels = FALLBACK_LABELS | {"discipline": disciplines}
    option = lambda x: F.struct(F.lit(x).alias("label"), F.col("page_url").alias("url"))
    fallback = [F.struct(F.lit(k).alias("kind"), F.array(*[option(x) for x in labels[k]]).alias("options")) for k in MENU_KINDS]
    rest = pages.join(chosen.select(key).distinct(), key, "left_anti").select(key, F.inline(F.array(*fallback)))
    both = entries.withColumn("degraded", F.lit(False)).unionByName(rest.withColumn("degraded", F.lit(True)))
    return both.select(key, "kind", "options", F.col("options")[0]["label"].alias("selected"), "degraded")


def selection_targets(targets: DataFrame, key: str) -> DataFrame:
    """key, kind, number, selector, name, n, samples: tables with two data rows or more, classes with three linked cells or more; from html_targets."""
    groups = targets.groupBy(key, "kind", "number", "selector", "name")
    least = F.create_map(*[F.lit(x) for pair in LEAST_TARGETS.items() for x in pair])
    cut = lambda kind: F.transform(F.slice(F.col("_told"), 1, SAMPLES[kind][0]), lambda s: F.substring(s, 1, SAMPLES[kind][1]))
    first = lambda kind: F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", "sample"))), lambda x: x["sample"]), 1, SAMPLES[kind][0])
    rows = groups.agg(F.count(F.lit(1)).alias("n"), F.when(F.col("kind") == "table", first("table")).otherwise(first("calendar")).alias("_told"))
    rows = rows.where(F.col("n") >= least[F.col("kind")]).withColumn("_told", F.filter("_told", lambda s: s != "")).where(F.size("_told") > 0)
    return rows.select(key, "kind", "number", "selector", "name", "n", F.when(F.col("kind") == "table", cut("table")).otherwise(cut("calendar")).alias("samples"))
