"""What follows the row generators: table records with teams, selected records, classes of content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

#: Row classes of team headers and members, the team of single starters, the label before a team's name.
TEAM_ROW, MEMBER_ROW, SINGLE, TEAM_LABEL = "ligneequipe", "tablesorter-childRow", "INDIVIDUEL", r"(?i)^Équipe\s*:\s*"
#: Categories of class names, in the order in which they are tried, and their order in reports.
CATEGORY_PATTERNS = {
    "title": (r"title|titre|heading|headline|name|nom", r"\bh[1-3]\b", r"product.?name|item.?name|card.?title"),
    "description": (r"desc|description|summary|abstract|excerpt|synopsis|overview|content|text|body", r"detail|info|bio|about"),
    "price": (r"price|prix|cost|amount|tarif|rate|fee", r"sale|promo|discount|reduction"),
    "date": (r"date|time|posted|publish|created|updated|when|timestamp", r"ago|since|schedule"),
    "image": (r"image|img|photo|picture|thumb|avatar|cover|poster|banner", r"media|visual|illustration"),
    "link": (r"link|url|href|anchor|nav|permalink", r"btn|button|action|cta"),
    "tag": (r"tag|label|badge|category|categ|genre|type|status|chip",),
    "rating": (r"rating|rate|score|star|review|note|vote",),
    "author": (r"author|auteur|writer|creator|user|member|artist",),
}


def table_records(cells: DataFrame, key: str) -> DataFrame:
    """row_records from html_cells, a row a cell."""
    held = cells.groupBy(key, "table", "row", "row_class").agg(F.array_sort(F.collect_list(F.struct("position", "column", "value", "href"))).alias("cells"))
    return row_records(held, key)


def cells_of(rows: DataFrame) -> DataFrame:
    """Rows of html_table_rows with their cells as row_records takes them."""
    cell = lambda x, i: F.struct(i.alias("position"), x["columns"].alias("column"), x["values"].alias("value"), x["hrefs"].alias("href"))
    return rows.withColumn("cells", F.transform(F.arrays_zip("columns", "values", "hrefs"), cell)).drop("columns", "values", "hrefs")


def row_records(rows: DataFrame, key: str) -> DataFrame:
    """key, table, row, team and record (a map of columns), one per data row.

    rows: key, table, row, row_class and cells (position, column, value, href, by position). Ranking columns
    are cleaned; rows with a marker of non-participation go; a member row takes its team's name from the team
    row above it, and its ranking values where its own are empty. A cell's link is <column>_url, the first of
    a row is href. A row's cells stay together, so that only rows are shuffled, once, to meet their teams.
    """
    has_class = lambda name: F.array_contains(F.split("row_class", r"\s+"), name)
    cleaned = lambda x: F.when(t.is_ranking_name(x["column"]), t.ranking_number(t.clean_ordinal(x["value"]))).otherwise(x["value"])
    rows = rows.withColumns({"absent": F.exists("cells", lambda x: t.did_not_start(x["value"])), "is_team": has_class(TEAM_ROW), "member": has_class(MEMBER_ROW) & ~has_class(TEAM_ROW)})
    rows = rows.withColumn("cells", F.transform("cells", lambda x: F.struct(x["position"].alias("position"), x["column"].alias("column"), cleaned(x).alias("value"), x["href"].alias("href"))))
    # The first cell of a name counts, one with a value before those without, so names are unique before they become a map's keys.
    place = lambda x: F.struct(F.coalesce(x["value"] == "", F.lit(True)), x["position"])
    first = F.filter("cells", lambda x: ~F.exists("cells", lambda y: (y["column"] == x["column"]) & (place(y) < place(x))))
    rows = rows.withColumn("first", F.when(F.size(F.array_distinct("cells.column")) == F.size("cells"), F.col("cells")).otherwise(first))
    pairs = lambda kept: F.map_from_entries(F.transform(F.filter("first", kept), lambda x: F.struct(x["column"], x["value"])))
    links = F.transform(F.filter("first", lambda x: x["href"] != ""), lambda x: F.struct(F.concat(x["column"], F.lit("_url")), x["href"]))
    names = F.transform(F.filter("cells", lambda x: x["position"] == 1), lambda x: F.regexp_replace(x["value"], TEAM_LABEL, ""))
    rows = rows.select(
        key, "table", "row", "is_team", "member", "absent",
        pairs(lambda x: x["value"] != "").alias("values"),
        F.map_from_entries(links).alias("links"),
        F.get(F.filter("cells", lambda x: x["href"] != ""), 0)["href"].alias("href"),
        F.when(F.col("is_team"), F.array_max(names)).alias("team_name"),
        F.when(F.col("is_team"), pairs(lambda x: (x["value"] != "") & (x["position"] != 1))).alias("team_values"),
    )
    # The team of a member: the nearest row above that is no member, if it is a team row.
    above = Window.partitionBy(key, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(~F.col("member"), F.struct("is_team", "team_name", "team_values")), ignorenulls=True).over(above)
    rows = rows.withColumn("head", F.when(F.col("member"), head)).where("NOT is_team AND NOT absent AND size(values) > 0")
    mine = F.col("head.is_team")
    filled = F.when(mine, F.map_concat(F.map_filter("head.team_values", lambda k, v: ~F.array_contains(F.map_keys("values"), k)), "values")).otherwise(F.col("values"))
    href = F.when(F.col("href") != "", F.map_from_arrays(F.array(F.lit("href")), F.array("href"))).otherwise(F.create_map().cast("map<string,string>"))
    team = F.when(mine & (F.col("head.team_name") != ""), F.col("head.team_name")).otherwise(F.lit(SINGLE))
    return rows.select(key, "table", "row", team.alias("team"), F.map_concat(filled, "links", F.map_filter(href, lambda k, v: ~F.array_contains(F.map_keys("values"), k))).alias("record"))


def selected_records(cells: DataFrame, key: str) -> DataFrame:
    """key, position, record: one per group of html_select, the first value of each column, with the first link as href."""
    first = Window.partitionBy(key, "group", "column").orderBy("position")
    kept = cells.withColumn("_n", F.row_number().over(first))
    rows = kept.groupBy(key, "group").agg(
        F.min("position").alias("position"),
        F.map_from_entries(F.collect_list(F.when((F.col("_n") == 1) & (F.col("column") != "href"), F.struct("column", "value")))).alias("values"),
        F.min_by("href", F.when(F.col("href") != "", F.col("position"))).alias("href"),
    )
    href = F.when(F.col("href") != "", F.map_from_arrays(F.array(F.lit("href")), F.array("href"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(key, "position", F.map_concat("values", href).alias("record"))


def content_classes(names: DataFrame, key: str, least: int = 2) -> DataFrame:
    """class, category, n, pages, sample, place: class names by category, in report order, then by frequency.

    names: key, class, position, sample. A class with no category, or in fewer than `least` elements, is left out.
    """
    category = F.coalesce(*[F.when(F.col("class").rlike("(?i)" + "|".join(p)), c) for c, p in CATEGORY_PATTERNS.items()])
    counts = names.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("pages"), F.min_by("sample", F.struct(key, "position")).alias("sample"))
    rows = counts.where(F.col("n") >= least).withColumn("category", category).where("category IS NOT NULL")
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_PATTERNS]), F.col("category"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "class"))).withColumn("category_place", order.cast("int"))


def repeated_groups(rows: DataFrame, key: str, least: int = 3, share: float = 0.6, most_children: int = 8, most_groups: int = 10) -> DataFrame:
    """key, parent_class, child_class, n, instances: in each page, parents with `least` instances and two classes or more in most of them.

    rows: key, parent_class, instance, child_class. At most the 8 most frequent children of
    a parent and the 10 most frequent parents of a page are the feature's limits.
    """
    # Both counts in one pass over the pages: a parent's instances are gathered from those of its children.
    seen = rows.groupBy(key, "parent_class", "child_class").agg(F.collect_set("instance").alias("_seen")).withColumn("n", F.size("_seen").cast("long"))
    whole = seen.groupBy(key, "parent_class").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_seen")))).cast("long").alias("instances"), F.collect_list(F.struct("child_class", "n")).alias("_children"))
    children = whole.where(F.col("instances") >= least).select(key, "parent_class", "instances", F.inline("_children"))
    children = children.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("instances") * share)))
    by_parent = Window.partitionBy(key, "parent_class")
    kept = children.withColumn("_n", F.row_number().over(by_parent.orderBy(F.desc("n"), "child_class"))).withColumn("_all", F.count(F.lit(1)).over(by_parent))
    kept = kept.where((F.col("_n") <= most_children) & (F.col("_all") >= 2))
    kept = kept.withColumn("_place", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("instances"), "parent_class")))
    return kept.where(F.col("_place") <= most_groups).select(key, "parent_class", "child_class", "n", "instances")


def label_of_link(links: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, href, label: the text of the first anchor that is a wanted link - by href, by absolute URL, or by its state token.

    links: key, position, text, href, target. wanted: key, href, target. "" where there is none.
    """
    token = lambda c: F.nullif(F.regexp_extract(c, r"[?&]cs=([^&#]*)", 1), F.lit(""))
    named = links.where(t.strip(F.col("text")) != "").select(key, "position", "text", F.col("href").alias("_href"), F.col("target").alias("_target"))
    same = (F.col("href") == F.col("_href")) | (F.col("target") == F.col("_target")) | F.coalesce(token(F.col("target")) == token(F.col("_target")), F.lit(False))
    hit = wanted.join(named, key).where(same).groupBy(key, "href").agg(F.min_by(t.strip(F.col("text")), F.col("position")).alias("label"))
    return wanted.select(key, "href").distinct().join(hit, [key, "href"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def link_of_label(links: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, label, href: the first anchor whose text is the label, case aside; "" where there is none."""
    same = lambda c: F.lower(t.strip(F.col(c)))
    named = links.select(key, "position", same("text").alias("_text"), F.col("href"))
    asked = wanted.select(key, "label").distinct().withColumn("_text", same("label"))
    hit = asked.where("_text <> ''").join(named, [key, "_text"]).groupBy(key, "label").agg(F.min_by("href", "position").alias("href"))
    return asked.select(key, "label").join(hit, [key, "label"], "left").withColumn("href", F.coalesce("href", F.lit("")))
