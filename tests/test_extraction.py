"""Selectors, table records with teams, links, calendars, fields, group mining and URL filters on small pages."""

import json

import pytest
from pyspark.sql import functions as F

from turfline.functions import html_rows as hr
from turfline.functions import html_select as hs
from turfline.functions import text as t
from turfline.operators import extraction, places

TABLE = """<table id="t_engts"><thead><tr><th>Clt.</th><th>Cavalier</th><th>Club</th><th>Équidé</th></tr></thead>
<tr><td>1 er</td><td><a href="/r/1">Ann</a></td><td>Lons</td><td>El Caballo</td></tr>
<tr><td>El.</td><td>Bea</td><td></td><td><a href="javascript:void(0)" onclick="$.ajax({url:'./?cs=4.ab'})" title="Icy"></a></td></tr>
<tr><td>Forfait</td><td>Cid</td><td>Pau</td><td>Duc</td></tr>
<tr class="ligneequipe"><td>2 ème</td><td>Équipe : Les Verts</td><td></td><td></td></tr>
<tr class="tablesorter-childRow"><td></td><td>Dan</td><td>Dax</td><td>Eos</td></tr>
<tr class="tablesorter-childRow"><td>3</td><td>Eva</td><td></td><td>Fee</td></tr>
<tr><td>abc</td><td>Flo</td><td></td><td>Gin</td></tr>
<tr class="tablesorter-childRow"><td></td><td>Guy</td><td></td><td>Hop</td></tr></table>"""


def generated(spark, generator, html, arguments="html"):
    hr.register(spark)
    hs.register(spark)
    spark.createDataFrame([(1, html), (2, "")], "page_id long, html string").createOrReplaceTempView("fixture_pages")
    return spark.sql(f"SELECT page_id, t.* FROM fixture_pages, LATERAL {generator}({arguments}) t")


def test_table_records_with_teams(spark):
    rows = extraction.table_records(generated(spark, "html_cells", TABLE), "page_id").orderBy("row").collect()
    got = [(r.team, dict(r.record)) for r in rows]
    assert got == [
        ("INDIVIDUEL", {"Clt.": "1", "Cavalier": "Ann", "Club": "Lons", "Équidé": "El Caballo", "Cavalier_url": "/r/1", "href": "/r/1"}),
        ("INDIVIDUEL", {"Clt.": "-1", "Cavalier": "Bea", "Équidé": "Icy", "Équidé_url": "./?cs=4.ab", "href": "./?cs=4.ab"}),
        ("Les Verts", {"Clt.": "2", "Cavalier": "Dan", "Club": "Dax", "Équidé": "Eos"}),
        ("Les Verts", {"Clt.": "3", "Cavalier": "Eva", "Équidé": "Fee"}),
        ("INDIVIDUEL", {"Clt.": "-1", "Cavalier": "Flo", "Équidé": "Gin"}),
        ("INDIVIDUEL", {"Cavalier": "Guy", "Équidé": "Hop"}),
    ]


def test_selected_records_group_by_row_and_card(spark):
    html = """<div class=box><span class=label><strong>Robe :</strong> Bai</span><span class=label><strong>Sexe :</strong> F</span><span class=label><strong>Club</strong></span></div>
    <a href=/x><i class=name>Out</i></a><table><tr><td class=day>12</td><td class=ev><a href=/e/1>Cup</a></td></tr><tr><td class=day>13</td></tr></table>"""
    rows = extraction.selected_records(generated(spark, "html_select", html, "html, '.label, .name, table tbody td.day, td.ev'"), "page_id").orderBy("position")
    got = [dict(r.record) for r in rows.collect()]
    assert got == [{"Robe": "Bai", "Sexe": "F"}, {"name": "Out", "href": "/x"}, {"day": "12", "ev": "Cup", "href": "/e/1"}, {"day": "13"}]


def test_selectors():
    root = hr.tree("<div id=a class='x y'><p class=x>1</p><ul><li data-k='abc'>2<li class=z>3</ul></div><p>4</p>")
    texts = lambda s: [n.text() for n in hs.select(root, s)]
    assert texts("#a > p") == ["1"] and texts("div p.x") == ["1"] and texts("p") == ["1", "4"]
    assert texts("div > li") == [] and texts("[data-k^=ab]") != [] and texts("#a.x.y [data-k]") != []
    assert hs.is_selector("a.b") and not hs.is_selector("plain name")
    with pytest.raises(ValueError):
        hs.select(root, "p::before")


def test_links_and_calendars():
    html = """<a href='/one'>One</a><a href=/two>Two</a><a href="#">no</a><div data-href="/three">Three</div>
    <div class="fc-event" data-date="2026-05-01"><b class=fc-title>Cup</b> at noon</div><time datetime="2026-06-02">2 June</time>
    <form><label for=s>Find</label><input id=s name=q><input type=hidden name=h><input name=from_date><select name=kind><option value=1>A</option><option>B</option></select></form>
    <div class="dropdown-menu" id=year><a href="?y=1">One</a><a href="javascript:x">No</a></div>"""
    assert list(hs.rows_of(hs.HtmlLinks, html))[:3] == [(0, "One", "/one"), (1, "Two", "/two"), (2, "Three", "/three")]
    assert ("calendar_event", "div", "Cup", "2026-05-01", "class-pattern") in list(hs.rows_of(hs.HtmlCalendar, html))
    assert ("calendar_time", "time", "2 June", "2026-06-02", "time") in list(hs.rows_of(hs.HtmlCalendar, html))


def test_a_failing_extractor_is_a_row(monkeypatch):
    class Broken:
        def eval(self, html):
            raise ValueError("no")
            yield

    monkeypatch.setitem(hs.EXTRACTORS, "html_media", (Broken, ()))
    rows = list(hs.rows_of(hs.HtmlExtract, "<p>a</p><a href=/b>b</a>"))
    assert ("html_media", -1, None, "ValueError: no") in rows
    assert json.loads(next(r for n, _, r, _ in rows if n == "html_links")) == [0, "b", "/b"]


def test_repeated_groups(spark):
    card = "<div class='card wide'><span class=nm>a</span><b class=px>1</b></div>"
    html = f"<div class=page>{card * 4}<div class=card><i class=nm>x</i></div></div>"
    rows = extraction.repeated_groups(generated(spark, "html_classes", html), "page_id").collect()
    assert {(r.parent_class, r.child_class, r.n, r.instances) for r in rows} == {(p, c, 4, 4) for p in ("card", "wide") for c in ("nm", "px")}


@pytest.mark.parametrize(
    "url, values, want",
    [
        ("http://h/p?a=1", {"b": "2"}, "http://h/p?a=1&b=2"),
        ("http://h/p?a=1", {"a": "9", "n": "", "m": None}, "http://h/p?a=9"),
        ("http://h/p?a=1", {"x": "?c=3", "b": "2"}, "http://h/p?c=3&b=2"),
        ("http://h/p?a=1", {"x": "/q?z=1"}, "http://h/q?z=1"),
        ("http://h/p", {"x": "https://o/", "y": "1"}, "https://o/?y=1"),
        ("http://h/p?a=1&a=2&c=3#top", {"b": "x y&z"}, "http://h/p?a=1&a=2&c=3&b=x+y%26z#top"),
        ("http://h/p?a=1&a=2&c=3", {"a": "é"}, "http://h/p?c=3&a=%C3%A9"),
        ("http://h/p?a%20b=1&c=2", {"a b": "7"}, "http://h/p?c=2&a+b=7"),
        ("http://h/p?a=1#f", {"x": "?b=2", "y": "/z"}, "http://h/z#f"),
        ("http://h", {"y": "?"}, "http://h"),
        ("http://h/p", {"y": "?", "k": " v "}, "http://h/p?k=v"),
        ("/rel/p?a=1", {"x": "/q"}, "/q"),
        ("http://h/p", {}, "http://h/p"),
    ],
)
def test_filters_in_urls(spark, url, values, want):
    df = spark.createDataFrame([(url, list(values.items()))], "u string, v array<struct<k:string,v:string>>")
    assert df.select(t.url_with_filters(F.col("u"), F.map_from_entries("v"))).first()[0] == want


def test_places_in_one_order_and_in_groups(spark):
    rows = [(k % 3 if k % 11 else None, (k * 7919) % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "g long, x long, k long").repartition(7)
    want = {k: i for i, (_, _, k) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    assert {r.k: r.place for r in places.with_place(df, [F.col("x"), F.col("k")], "place").collect()} == want
    inside = {r.k: (r.place, r.place_of) for r in places.with_place(df, [F.col("x"), F.col("k")], "place", "g").collect()}
    for g in (None, 0, 1, 2):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert all(inside[r[2]] == (i, len(mine)) for i, r in enumerate(mine, 1))
    assert places.with_place(df.limit(0), [F.col("x")], "place").count() == 0


def test_labels_and_links_find_each_other(spark):
    links = spark.createDataFrame([(1, 0, "", "?cs=4.a", "http://h/?cs=4.a"), (1, 1, " North ", "?cs=4.a", "http://h/?cs=4.a"), (1, 2, "South", "/s", "http://h/s"), (2, 0, "North", "/n", "http://h/n")], "page_id long, position int, text string, href string, target string")
    wanted = spark.createDataFrame([(1, "/x?cs=4.a", "http://h/x?cs=4.a"), (1, "s", "http://h/s"), (1, "/none", "http://h/none"), (2, "/n", "http://o/n")], "page_id long, href string, target string")
    got = {(r.page_id, r.href): r.label for r in extraction.label_of_link(links, wanted, "page_id").collect()}
    assert got == {(1, "/x?cs=4.a"): "North", (1, "s"): "South", (1, "/none"): "", (2, "/n"): "North"}
    asked = spark.createDataFrame([(1, "NORTH"), (2, "south"), (1, " ")], "page_id long, label string")
    assert {(r.page_id, r.label): r.href for r in extraction.link_of_label(links, asked, "page_id").collect()} == {(1, "NORTH"): "?cs=4.a", (2, "south"): "", (1, " "): ""}
