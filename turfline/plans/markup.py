"""Queries over pages that Spark writes from the tables' rows, so that the twins know what must be found in them.

Each page holds the structures that one operator looks for, in all the places where it looks; which
place a page uses depends on its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import html_context, html_rows, html_select
from ..functions import text as t
from ..operators import chain, controls, extraction
from ..operators import documents as docs
from ..operators.relational import spread
from ..staging import stage
from .bindings import table
from .define import query


def generated(pages: DataFrame, key: str, generator: str, *arguments: object) -> DataFrame:
    """A row generator over pages of key and html, as its UDTF gives them, with whole batches of rows handed back through Arrow."""
    make, returns = (html_rows.GENERATORS | html_select.GENERATORS | html_context.GENERATORS)[generator]
    source = pages.select(key, "html")
    schema = StructType([source.schema[0], *StructType.fromDDL(returns).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        for batch in batches:
            found: list[tuple] = []
            for k, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += [(k, *row) for row in make().eval(html, *arguments)]
                if len(found) >= ROWS_BACK:
                    yield _record_batch(found, types)
                    found = []
            if found:
                yield _record_batch(found, types)

    return source.mapInArrow(rows, schema)


#: Rows that a generator hands back at once: a batch of pages may hold many more.
ROWS_BACK = 10_000


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _case(key: str, n: int, texts: list[str]) -> Column:
    """The text at key % n."""
    return F.element_at(F.array(*[F.expr(x) for x in texts]), (F.col(key) % n + 1).cast("int"))


# Controls: a page a customer.


def control_pages(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    peers = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("peers"))
    rows = spread(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    rows = rows.join(F.broadcast(peers), "n_regionkey").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    links = _joined(F.transform("peers", lambda n: F.concat(F.lit('<a class="dropdown-item'), F.when(n["n_nationkey"] == F.col("c_nationkey"), " active").otherwise(""), F.lit('" href="./?cs=4.'), n["n_nationkey"], F.lit('">'), n["n_name"], F.lit("</a>"))))
    choices = _joined(F.transform("peers", lambda n: F.concat(F.lit('<option value="'), n["n_nationkey"], F.lit('">'), n["n_name"], F.lit("</option>"))))
    toggle = _case("c_custkey", 3, ["concat('>Pays de ', r_name)", "' aria-label=\"Pays\">'", "'>'"])
    menu = F.concat(F.lit('<div class="btn-group"><button data-toggle="dropdown"'), toggle, F.lit('</button><div class="dropdown-menu">'), links, F.lit("</div></div>"))
    html = F.concat(
        F.lit('<html lang="fr"><body><nav><span data-toggle="dropdown">Menu</span><ul class="menu-list">'), links, F.lit('</ul></nav><form action="/clients/'), F.col("c_custkey"),
        F.lit('" method="post"><legend>Fiche</legend><p><label for="k">Client '), F.col("c_custkey"), F.lit('</label><input id="k" name="num"></p><p><span>Segment</span><input type="checkbox" name="seg" value="'),
        F.col("c_mktsegment"), F.lit('"></p><p><input name="deb" placeholder="jj/mm/aaaa"></p><p><select name="nation">'), choices,
        F.lit('</select></p><p><label>Montant <input type="radio" name="tri" value="asc"></label><label>Date <input type="radio" name="tri"></label></p><div class="card"><div class="card-header">Solde</div>'
              '<div><textarea name="note" placeholder="texte"></textarea></div></div><input type="hidden" name="jeton" value="1"></form><input type="search" name="terme" placeholder="Nom">'
              '<input name="q" title="Tout"><select name="ordre"><option value="1">Croissant<option value="2">Inverse</select><input name="autre"><input type="date" name="jour">'), menu, menu, F.lit("</body></html>"),
    )
    return rows.select("c_custkey", html.alias("html"))


#: What control_pages hold: one row a field.
_FIELDS = """peers AS (
  SELECT n_regionkey, string_agg(n_nationkey || '=' || n_name, '|' ORDER BY n_name) AS coded, string_agg(n_name || '=' || n_name, '|' ORDER BY n_name) AS named FROM nation GROUP BY n_regionkey),
c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN peers USING (n_regionkey)),
menus AS (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'Pays de ' || r_name WHEN 1 THEN 'Pays' ELSE n_name END AS told FROM c),
fields AS (
  SELECT c_custkey, 'form' AS area, 0 AS position, 'text' AS kind, 0 AS score, 'num' AS name, 'Client ' || c_custkey AS label, '' AS options FROM c
  UNION ALL SELECT c_custkey, 'form', 1, 'checkbox', 8, 'seg', 'Segment', '' FROM c
  UNION ALL SELECT c_custkey, 'form', 2, 'date', 4, 'deb', 'Fiche', '' FROM c
  UNION ALL SELECT c_custkey, 'form', 3, 'select', 8, 'nation', 'Fiche', coded FROM c
  UNION ALL SELECT c_custkey, 'form', 4, 'radio', 8, 'tri', 'Montant', '' FROM c
  UNION ALL SELECT c_custkey, 'form', 5, 'radio', 8, 'tri', 'Date', '' FROM c
  UNION ALL SELECT c_custkey, 'form', 6, 'text', 0, 'note', 'Solde', '' FROM c
  UNION ALL SELECT c_custkey, 'search', 7, 'search', 2, 'terme', 'Nom', '' FROM c
  UNION ALL SELECT c_custkey, 'search', 8, 'search', 1, 'q', 'Tout', '' FROM c
  UNION ALL SELECT c_custkey, 'filter', 9, 'select', 8, 'ordre', 'ordre', 'Croissant=Croissant|Inverse=Inverse' FROM c
  UNION ALL SELECT c_custkey, 'filter', 11, 'date', 8, 'jour', 'jour', '' FROM c
  UNION ALL SELECT c_custkey, 'filter', 13, 'select', 8, lower(replace(told, ' ', '_')), told, named FROM menus)"""


def _told(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["value"], F.lit("="), o["label"])), "|")


@query(f"WITH {_FIELDS} SELECT * FROM fields")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of forms, filters and search boxes of every page, told by evidence, with labels and options."""
    fields = controls.detected_fields(generated(control_pages(spark, d), "c_custkey", "html_controls"), "c_custkey")
    return fields.select("c_custkey", "area", "position", "kind", "score", "name", "label", _told(F.col("options")).alias("options"))


@query(
    f"""WITH {_FIELDS}, x AS (
  SELECT f.* REPLACE (CASE kind WHEN 'checkbox' THEN c_mktsegment || '=' || label WHEN 'radio' THEN CASE label WHEN 'Montant' THEN 'asc' ELSE 'on' END || '=' || label ELSE options END AS options)
  FROM fields f JOIN customer USING (c_custkey))
SELECT c_custkey, area, min(position) AS position, name, any_value(kind) AS kind, min_by(label, position) AS label, count(*) AS controls, string_agg(options, '|' ORDER BY position) AS options FROM x GROUP BY c_custkey, area, name"""
)
def page_filters(spark: SparkSession, d: str) -> DataFrame:
    """Fields merged into one filter per form and name."""
    fields = controls.detected_fields(generated(control_pages(spark, d), "c_custkey", "html_controls"), "c_custkey")
    merged = controls.merged_filters(fields, "c_custkey")
    return merged.select("c_custkey", "area", "position", "name", "kind", "label", "controls", _told(F.col("options")).alias("options"))


@query("SELECT c_custkey, '/clients/' || c_custkey AS action, 'POST' AS method, 7 AS n_fields, 'num,seg,deb,nation,tri,tri,note' AS names FROM customer")
def page_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms with their fields in order."""
    fields = controls.detected_fields(generated(control_pages(spark, d), "c_custkey", "html_controls"), "c_custkey")
    forms = controls.form_descriptors(fields, "c_custkey")
    return forms.select("c_custkey", "action", "method", F.size("fields").alias("n_fields"), F.array_join(F.transform("fields", lambda f: f["name"]), ",").alias("names"))


# Calendars: a page a customer and month.

_MONTH_NAMES = ["Janvier", "February", "Mars", "April", "Mai", "June", "Juillet", "August", "Septembre", "October", "Novembre", "December"]


def calendar_pages(spark: SparkSession, d: str) -> DataFrame:
    """Days of orders in a table cell each; the month stands in the caption, a header cell, the second element before, or a heading of the grandparent."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    cell = F.concat(F.lit('<td class="on"><a href="/o/'), F.col("o_orderkey"), F.lit('">'), F.dayofmonth("o_orderdate"), F.lit("</a></td>"))
    rows = spread(orders, "o_custkey").groupBy("o_custkey", "month").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cell.alias("cell")))).alias("cells"))
    year, name = F.substring("month", 1, 4), F.element_at(F.array(*[F.lit(m) for m in _MONTH_NAMES]), F.substring("month", 6, 2).cast("int"))
    rows = rows.withColumn("head", F.when(F.col("o_custkey") % 2 == 0, F.concat_ws(" ", name, year)).otherwise(F.concat_ws(", ", year, name)))
    before = _case("o_custkey", 4, ["'<section><div>'", "'<section><div>'", "concat('<section><div><p>', head, '</p><p>2 jours</p>')", "concat('<section><h3>', head, '</h3><div>')"])
    inside = _case("o_custkey", 4, ["concat('<caption>', head, '</caption>')", "concat('<thead><tr><th>Jours</th><th>', head, '</th></tr></thead>')", "''", "''"])
    html = F.concat(F.lit("<body><h1>Tout 1999</h1>"), before, F.lit("<table>"), inside, F.lit("<tr>"), _joined(F.transform("cells", lambda c: c["cell"])), F.lit("</tr></table><a>12</a></div></section></body>"))
    return rows.select(F.concat_ws("/", "o_custkey", "month").alias("page"), html.alias("html"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE o_custkey % 4 WHEN 0 THEN 'caption' WHEN 1 THEN 'head' WHEN 2 THEN 'sibling' ELSE 'ancestor' END AS place FROM orders")
def calendar_dates(spark: SparkSession, d: str) -> DataFrame:
    """Calendar cells with their ISO date, from the nearest heading that holds a month."""
    cells = controls.calendar_cells(generated(calendar_pages(spark, d), "page", "html_anchors"), "page")
    return cells.select(F.regexp_extract("href", r"(\d+)$", 1).cast("bigint").alias("o_orderkey"), "date", "place")


@query(
    """SELECT o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS page, '.on' AS selector, count(*) AS n, string_agg(day(o_orderdate)::VARCHAR, ',' ORDER BY o_orderkey) FILTER (place <= 10) AS samples
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS place FROM orders) GROUP BY 1 HAVING count(*) >= 3"""
)
def calendar_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of linked cells that fill a calendar."""
    found = controls.selection_targets(generated(calendar_pages(spark, d), "page", "html_targets"), "page")
    return found.where("kind = 'calendar'").select("page", "selector", "n", F.array_join("samples", ",").alias("samples"))


# Tables of entries: a page an order.


def entry_pages(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as members of teams by line status, with an absent starter, ordinals and a table's id or class."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", F.col("l_quantity").cast("int").alias("q"))
    place = F.when(F.col("q") % 10 == 0, F.lit("Non partant")).when(F.col("q") == 1, F.lit("1 er")).otherwise(F.concat("q", F.lit(" e")))
    # A first cell between the ranks of a team's row and its members.
    cell = F.concat(F.lit('<tr class="'), F.when(F.col("q") > 3, "tablesorter-childRow").otherwise("solo"), F.lit('"><td>'), place, F.lit('</td><td data-label="Cheval">Cheval '), F.col("l_partkey"), F.lit('</td><td data-label="Club"><a href="/c/'), F.col("l_suppkey"), F.lit('">Club '), F.col("l_suppkey"), F.lit("</a></td></tr>"))
    rows = spread(line, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("q") > 3, 1).otherwise(0).alias("team"), "l_linenumber", cell.alias("cell")))).alias("rows"))
    name = _case("l_orderkey", 3, ["' id=\"t_engts\"'", "' class=\"table mt-2 tarifs\"'", "' class=\"table\"'"])
    team = F.concat(F.lit('<tr class="ligneequipe"><td>7</td><td data-label="Cheval">Équipe : Rouge '), F.col("l_orderkey"), F.lit("</td><td></td></tr>"))
    members = lambda t: _joined(F.transform(F.filter("rows", lambda r: r["team"] == t), lambda r: r["cell"]))
    html = F.concat(F.lit("<body><table"), name, F.lit("><thead><tr><th>Rang</th><th>Cheval</th><th>Club</th></tr></thead><tbody>"), members(0), team, members(1), F.lit("</tbody></table></body>"))
    return rows.select("l_orderkey", html.alias("html"))


@query(
    """SELECT l_orderkey, CASE WHEN q > 3 THEN 'Rouge ' || l_orderkey ELSE 'INDIVIDUEL' END AS team, q::VARCHAR AS rank, 'Cheval ' || l_partkey AS horse, 'Club ' || l_suppkey AS club, '/c/' || l_suppkey AS href
FROM (SELECT *, l_quantity::INTEGER AS q FROM lineitem) WHERE q % 10 <> 0"""
)
def team_records(spark: SparkSession, d: str) -> DataFrame:
    """Table rows as records: cleaned ranks, teams handed on to their members, absent starters left out."""
    rows = generated(entry_pages(spark, d), "l_orderkey", "html_table_rows")
    records = extraction.row_records(extraction.cells_of(rows), "l_orderkey")
    r = F.col("record")
    return records.select("l_orderkey", "team", r["Rang"].alias("rank"), r["Cheval"].alias("horse"), r["Club"].alias("club"), r["href"].alias("href"))


@query(
    """SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN '#t_engts tr' ELSE 'table.tarifs tr' END AS selector, count(*) + 1 AS n FROM lineitem
WHERE l_orderkey % 3 < 2 GROUP BY l_orderkey"""
)
def table_targets(spark: SparkSession, d: str) -> DataFrame:
    """Tables worth a selector, with their data rows."""
    found = controls.selection_targets(generated(entry_pages(spark, d), "l_orderkey", "html_targets"), "l_orderkey")
    return found.where("kind = 'table'").select("l_orderkey", "selector", "n")


# Cards: a page a customer with orders.


def card_pages(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as cards with a title, a price on some, and links that only a script follows on some."""
    cols = [F.col(c) for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")]
    link = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('href="/o/'), F.col("o_orderkey"), F.lit('"'))).otherwise(F.concat(F.lit("""href="javascript:void(0)" onclick="$.ajax({url: './?cs=4."""), F.col("o_orderkey"), F.lit("""'})" """)))
    flag = _case("o_orderkey", 4, ["' hreflang=\"en-GB\"'", "''", "''", "''"])
    inner = _case("o_orderkey", 4, ["''", "'<img src=\"/flags/jp.png\">'", "''", "''"])
    after = _case("o_orderkey", 4, ["''", "''", "'<i class=\"flag-icon-be\"></i>'", "''"])
    card = F.concat(
        F.lit('<div class="fiche"><h4 class="titre">Commande '), F.col("o_orderkey"), F.lit("</h4>"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit('<b class="prix">'), F.format_string("%.2f", "o_totalprice"), F.lit("</b>"))).otherwise(""),
        F.lit('<p class="lien"><a '), link, flag, F.lit(">"), inner, F.lit("Voir "), F.col("o_orderkey"), F.lit("</a>"), after, F.lit("</p></div>"),
    )
    orders = spread(table(spark, d, "orders").select(*cols), "o_custkey").select(*cols, card.alias("card"))
    rows = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "card"))).alias("cards"))
    page = _case("o_custkey", 3, ["'<html lang=\"de-AT\"><body>'", "'<html><head><meta property=\"og:locale\" content=\"it_IT\"></head><body>'", "'<html><body><div lang=\"es\">'"])
    return rows.select("o_custkey", F.concat(page, _joined(F.transform("cards", lambda c: c["card"])), F.lit("</body></html>")).alias("html"))


_NEAR = "CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'fr' ELSE CASE o_custkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'it' ELSE 'es' END END"


@query(f"SELECT o_orderkey, {_NEAR} AS language FROM orders")
def anchor_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of links by the nearest evidence: an attribute, a flag inside, one beside, an ancestor, the page."""
    anchors = generated(card_pages(spark, d), "o_custkey", "html_anchors")
    return anchors.select(F.regexp_extract("text", r"(\d+)$", 1).cast("bigint").alias("o_orderkey"), controls.anchor_language().alias("language"))


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/o/' || o_orderkey ELSE './?cs=4.' || o_orderkey END AS href, 'fiches' AS step_id,
  CASE WHEN o_orderkey % 2 = 0 THEN {_NEAR} ELSE (SELECT CASE min(x.o_orderkey) % 4 WHEN 1 THEN 'ja' ELSE CASE orders.o_custkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'it' ELSE 'es' END END FROM orders x WHERE x.o_custkey = orders.o_custkey AND x.o_orderkey % 2 = 1) END AS language
FROM orders"""
)
def enriched_links(spark: SparkSession, d: str) -> DataFrame:
    """Link rows with step, the target of scripted links, and language; scripted links share one address, so the first on the page tells their language."""
    anchors = stage(generated(card_pages(spark, d), "o_custkey", "html_anchors"), "anchors")
    rows = anchors.select("o_custkey", F.col("position").alias("row"), "text", "href")
    out = controls.enriched_rows(rows, anchors, "o_custkey", "fiches")
    return out.select(F.regexp_extract("text", r"(\d+)$", 1).cast("bigint").alias("o_orderkey"), "href", "step_id", "language")


_CARDS = "cards AS (SELECT o_custkey, count(*) AS instances, count(*) FILTER (o_orderkey % 5 > 0) AS priced, count(*) FILTER (o_orderkey % 4 = 2) AS flagged FROM orders GROUP BY o_custkey)"


@query(
    f"""WITH {_CARDS}, x AS (
  SELECT o_custkey, 'titre' AS child_class, instances AS n, instances FROM cards UNION ALL SELECT o_custkey, 'lien', instances, instances FROM cards UNION ALL SELECT o_custkey, 'prix', priced, instances FROM cards
  UNION ALL SELECT o_custkey, 'flag-icon-be', flagged, instances FROM cards),
y AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS k FROM x WHERE instances >= 3 AND n >= greatest(2, floor(instances * 0.6)))
SELECT o_custkey, 'fiche' AS parent_class, child_class, n, instances FROM y WHERE k >= 2"""
)
def card_groups(spark: SparkSession, d: str) -> DataFrame:
    """Repeated cards of every page, with the classes most of them hold."""
    classes = generated(card_pages(spark, d), "o_custkey", "html_classes")
    return extraction.repeated_groups(classes, "o_custkey")


@query(
    """WITH x AS (
  SELECT 'titre' AS class, 'title' AS category, count(*) AS n, count(DISTINCT o_custkey) AS pages FROM orders UNION ALL SELECT 'prix', 'price', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 5 > 0)
SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, class) AS place FROM x WHERE n >= 2"""
)
def card_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class names of all cards by what they stand for."""
    names = generated(card_pages(spark, d), "o_custkey", "html_class_names")
    return extraction.content_classes(names, "o_custkey").where("class IN ('titre', 'prix')").select("class", "category", "n", "pages", "place")


@query(
    """SELECT l_orderkey, 'Cheval ' || l_partkey AS horse, 'Club ' || l_suppkey AS club, '/c/' || l_suppkey AS href FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 'Équipe : Rouge ' || l_orderkey, NULL, NULL FROM lineitem"""
)
def selected_entries(spark: SparkSession, d: str) -> DataFrame:
    """Records of cells picked by selectors; cells of one row are one record."""
    rows = extraction.selected_records(generated(entry_pages(spark, d), "l_orderkey", "html_select", "tr > td[data-x], tbody td"), "l_orderkey")
    r = F.col("record")
    return rows.select("l_orderkey", r["Cheval"].alias("horse"), r["Club"].alias("club"), r["href"].alias("href"))


# A site in four levels: regions, nations, customers, orders.

_SITE = "https://site.example"


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a site. Nations are linked twice, and to another site; every fourth customer has no segment; the pages of every fifth are not stored."""
    region, nation, customer, orders = (table(spark, d, n) for n in ("region", "nation", "customer", "orders"))
    rows_of = lambda df, url, order, row: df.groupBy(url.alias("url")).agg(F.array_sort(F.collect_list(F.struct(order, row.alias("row")))).alias("rows"))
    cell = lambda label, *parts: F.concat(F.lit(f'<td data-label="{label}">'), *parts, F.lit("</td>"))
    link = lambda path, key, text: F.concat(F.lit(f'<a href="{path}'), F.col(key), F.lit('">'), text, F.lit("</a>"))
    regions = rows_of(region, F.lit(f"{_SITE}/"), "r_regionkey", cell("Region", link("./r/", "r_regionkey", F.col("r_name"))))
    twice = nation.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    path = F.when(F.col("again") < 2, F.concat(F.lit('<a href="/n/'), "n_nationkey", F.when(F.col("again") == 1, "#top").otherwise(""), F.lit('">'))).otherwise('<a href="https://other.example/n">')
    nations = rows_of(twice, F.concat(F.lit(f"{_SITE}/r/"), "n_regionkey"), F.struct("n_nationkey", "again").alias("k"), cell("Nation", path, F.col("n_name"), F.lit("</a>")))
    segment = F.when(F.col("c_custkey") % 4 == 0, F.lit("NONE")).otherwise(F.col("c_mktsegment"))
    customers = rows_of(customer, F.concat(F.lit(f"{_SITE}/n/"), "c_nationkey"), "c_custkey", F.concat(cell("Client", link("../c/", "c_custkey", F.concat(F.lit("Client "), F.col("c_custkey")))), cell("Segment", segment)))
    stored = orders.where("o_custkey % 5 <> 0")
    orders = rows_of(stored, F.concat(F.lit(f"{_SITE}/c/"), "o_custkey"), "o_orderkey", F.concat(cell("Commande", F.col("o_orderkey")), cell("Etat", F.col("o_orderstatus"))))
    every = [x.select("url", F.transform("rows", lambda r: r["row"]).alias("rows")) for x in (regions, nations, customers, orders)]
    together = every[0].union(every[1]).union(every[2]).union(every[3])
    return together.select("url", F.concat(F.lit("<table><tr>"), F.array_join("rows", "</tr><tr>"), F.lit("</tr></table>")).alias("html"))


_STEPS = [
    chain.Step("s1", 'td[data-label="Region"]', hand_down=("Region",)),
    chain.Step("s2", 'td[data-label="Nation"]', ("Nation",), hand_down=("Nation",)),
    chain.Step("s3", 'td[data-label="Client"], td[data-label="Segment"]', ("Segment",), hand_down=("Client",)),
    chain.Step("s4", 'td[data-label="Commande"], td[data-label="Etat"]', ("Commande", "Etat")),
]


@query(
    f"""WITH RECURSIVE pages AS (
  SELECT '{_SITE}/' AS url, '{_SITE}/r/' || r_regionkey AS target, r_name AS cell, NULL AS segment FROM region
  UNION ALL SELECT '{_SITE}/r/' || n_regionkey, target, n_name, NULL FROM nation, (SELECT unnest([0, 1, 2]) AS again), LATERAL (SELECT CASE WHEN again < 2 THEN '{_SITE}/n/' || n_nationkey ELSE 'https://other.example/n' END AS target)
  UNION ALL SELECT '{_SITE}/n/' || c_nationkey, '{_SITE}/c/' || c_custkey, 'Client ' || c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0
  UNION ALL SELECT '{_SITE}/c/' || o_custkey, NULL, o_orderkey::VARCHAR, o_orderstatus FROM orders WHERE o_custkey % 5 <> 0),
walk(step, source_url, target, cell, segment, path) AS (
  SELECT 1, url, target, cell, segment, []::VARCHAR[] FROM pages WHERE url = '{_SITE}/'
  UNION ALL SELECT w.step + 1, p.url, p.target, p.cell, p.segment, list_append(w.path, w.cell)
  FROM (SELECT DISTINCT step, target, cell, path FROM walk WHERE target IS NOT NULL) w JOIN pages p ON p.url = w.target WHERE w.step < 4)
SELECT 's' || step AS step_id, source_url, cell, segment, path[1] AS region, path[2] AS nation, path[3] AS client FROM walk"""
)
def chained_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a chain of four steps over stored pages, with what they inherit from the pages before."""
    rows = chain.run_chain(site_pages(spark, d), [f"{_SITE}/"], _STEPS)
    r, up = F.col("record"), F.col("inherited")
    cell = F.coalesce(r["Region"], r["Nation"], r["Client"], r["Commande"])
    return rows.select("step_id", "source_url", cell.alias("cell"), F.coalesce(r["Segment"], r["Etat"]).alias("segment"), up["Region"].alias("region"), up["Nation"].alias("nation"), up["Client"].alias("client"))


# Forms: a page a supplier.


def form_pages(spark: SparkSession, d: str) -> DataFrame:
    """Three forms that take different names, and values that fit the first, two alike, the third or none of them."""
    nations = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))  # one row, as many entries as nations
    rows = spread(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name"), "s_suppkey").join(F.broadcast(nations))
    options = _joined(F.transform("nations", lambda n: F.concat(F.lit("<option"), F.when(n["n_nationkey"] == F.col("s_nationkey"), " selected").otherwise(""), F.lit(">"), n["n_name"], F.lit("</option>"))))
    html = F.concat(
        F.lit('<form action="-"><input name="q" value="vide"></form><form action="../f1" method="post"><textarea name="note"></textarea><input type="hidden" name="jeton" value="'), F.col("s_suppkey"),
        F.lit('"><input name="nom" value="x"><select name="pays">'), options, F.lit('</select><input type="checkbox" name="actif" checked><input type="checkbox" name="autre"><input type="submit" name="ok" value="1"></form>'
        '<form action="https://other.example/f2"><input name="nom"><input name="ville"><input type="hidden" name="ville" value="caché"><textarea name="note"></textarea></form>'),
    )
    values = F.element_at(
        F.array(
            F.create_map(F.lit("q"), F.lit("a b&c"), F.lit("vide"), F.lit("")),
            F.create_map(F.lit("nom"), F.col("s_name"), F.lit("note"), F.lit("é")),
            F.create_map(F.lit("ville"), F.lit("X"), F.lit("nom"), F.lit("")),
            F.create_map(F.lit("inconnu"), F.lit("1"), F.lit("inconnu2"), F.lit("")),
        ),
        (F.col("s_suppkey") % 4 + 1).cast("int"),
    )
    return rows.select("s_suppkey", html.alias("html"), F.concat(F.lit(f"{_SITE}/s/"), "s_suppkey", F.lit("/?p=1")).alias("page_url"), values.alias("values"))


@query(
    f"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS form, CASE s_suppkey % 4 WHEN 0 THEN 1 ELSE 2 END AS score, CASE s_suppkey % 4 WHEN 1 THEN 'POST' ELSE 'GET' END AS method,
  CASE s_suppkey % 4 WHEN 0 THEN '{_SITE}/s/' || s_suppkey || '/?p=1' WHEN 1 THEN '{_SITE}/s/f1' ELSE 'https://other.example/f2' END AS target,
  CASE s_suppkey % 4 WHEN 0 THEN 'q=a+b%26c' WHEN 1 THEN 'jeton=' || s_suppkey || '&nom=' || replace(url_encode(s_name), '%20', '+') || '&actif=on&pays=' || replace(url_encode(n_name), '%20', '+') || '&note=%C3%A9' ELSE 'nom=&ville=cach%C3%A9' END AS body,
  CASE s_suppkey % 4 WHEN 0 THEN '{_SITE}/s/' || s_suppkey || '/?q=a+b%26c' WHEN 1 THEN '{_SITE}/s/f1' ELSE 'https://other.example/f2?nom=&ville=cach%C3%A9' END AS url
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 < 3"""
)
def form_submissions(spark: SparkSession, d: str) -> DataFrame:
    """What the best form of every page sends for a set of values."""
    pages = form_pages(spark, d)
    return controls.submissions(generated(pages, "s_suppkey", "html_submits"), pages, "s_suppkey").withColumn("score", F.col("score").cast("int"))


@query(
    f"""WITH x AS (SELECT s_suppkey, '{_SITE}/s/' || s_suppkey || '?a=1&a=2#top' AS url FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '{_SITE}/s/' || s_suppkey || '?a=1&a=2&b=x+y#top' WHEN 1 THEN '{_SITE}/s/' || s_suppkey || '?a=' || s_suppkey || '#top'
  WHEN 2 THEN '{_SITE}/s/' || s_suppkey || '?cs=4.' || s_suppkey || '&b=2#top' WHEN 3 THEN '{_SITE}/autre?z=1#top' ELSE 'https://other.example/?c=1' END AS url FROM x"""
)
def filtered_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs moved and completed by filter values: links among them, and parameters."""
    m = lambda *pairs: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in pairs])
    key = F.col("s_suppkey").cast("string")
    values = F.element_at(
        F.array(m("b", "x y", "c", ""), m("a", key), m("u", F.concat(F.lit("?cs=4."), key), "b", "2"), m("u", "?q=0", "v", "/autre?z=1"), m("u", "https://other.example/", "c", "1")), (F.col("s_suppkey") % 5 + 1).cast("int")
    )
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(f"{_SITE}/s/"), key, F.lit("?a=1&a=2#top")).alias("url"), values.alias("values"))
    return rows.select("s_suppkey", t.url_with_filters(F.col("url"), F.col("values")).alias("url"))


@query(
    """WITH x AS (SELECT l_orderkey % 7 AS shelf, l_orderkey, l_orderkey % 3 = 0 AS mark, count(*) AS n, count(*) FILTER (l_quantity::INTEGER > 3) AS members FROM lineitem GROUP BY l_orderkey),
c AS (SELECT shelf, mark, n, members, count(*) AS k FROM x GROUP BY ALL)
SELECT shelf, sum(k)::BIGINT AS pages, count(*) AS clusters, round(1 - count(*) / sum(k), 3) AS similarity, max(k) AS dominant_pages FROM c GROUP BY shelf"""
)
def structure_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike the pages of a group are by their skeletons: tables of the same class, rows and members are one cluster."""
    digest = html_rows.dom_fingerprint()
    pages = entry_pages(spark, d).select((F.col("l_orderkey") % 7).alias("shelf"), digest("html").alias("fingerprint"))
    return docs.structure_similarity(pages, "shelf", "fingerprint").drop("dominant")
