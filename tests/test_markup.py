"""Fields, calendars, languages and targets of hand-written pages; the language is held against a walk over the whole tree."""

import random
import re

import pytest

from turfline.functions import html_language as lang
from turfline.functions import html_rows
from turfline.functions.html_rows import HtmlLeaves, tree
from turfline.operators import chain, controls
from turfline.plans import markup, registry
from turfline.plans.markup import generated


def _fields(spark, html):
    rows = controls.detected_fields(generated(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html_controls"), "k")
    return [r.asDict() for r in rows.orderBy("position").collect()]


@pytest.mark.parametrize(
    "html, area, kind, label",
    [
        ('<form><input id="a" name="x"><label for="a">By id</label></form>', "form", "text", "By id"),
        ("<form><label>Around <b>it</b><p><input name='x'></p></label></form>", "form", "text", "Around it"),
        ("<form><label>a</label><i>no</i><span>Before</span><em></em><input name='x'></form>", "form", "text", "Before"),
        ("<form><span>" + "long " * 30 + "</span><input name='x' title='Own'></form>", "form", "text", "Own"),
        ("<form><h3>Title</h3><div><div><input name='x'></div></div></form>", "form", "text", "Title"),
        ("<form><h3>Far</h3><div><div><div><div><input name='x'></div></div></div></div></form>", "form", "text", "x"),
        ("<main><h3>No</h3><form><input name='x' placeholder='Shown'></form></main>", "form", "text", "Shown"),
        ("<form><input name='x' placeholder='jj/mm/aaaa'></form>", "form", "text", "jj/mm/aaaa"),
        ("<form><input name='date_debut'></form>", "form", "date", "date_debut"),
        ("<form><input name='du' type='search'></form>", "form", "date", "du"),
        ("<form><input name='keyword'></form>", "form", "search", "keyword"),
        ("<form><input name='q' type='checkbox'></form>", "form", "checkbox", "q"),
        ("<form><input name='q' role='searchbox' type='radio'></form>", "form", "radio", "q"),
        ("<form><textarea name='recherche'></textarea></form>", "form", "text", "recherche"),
        ("<input role='searchbox'>", "search", "search", "recherche"),
        ("<input placeholder='Rechercher'>", "search", "search", "Rechercher"),
        ("<input type='date'>", "filter", "date", "date"),
        ("<select><option>1</select>", "filter", "select", "filtre"),
    ],
)
def test_kinds_and_labels(spark, html, area, kind, label):
    (field,) = _fields(spark, html)
    assert (field["area"], field["kind"], field["label"]) == (area, kind, label)


def test_controls_that_are_no_fields(spark):
    assert _fields(spark, "<form><input type=hidden><input type=submit><input type=IMAGE><button>x</button></form><input name=du><textarea></textarea>") == []
    assert _fields(spark, "") == [] and _fields(spark, None) == []


def _menu(n, mark="", cls="dropdown-menu"):
    return f"<div class='{cls}'>" + "".join(f"<a class='{'active' if i == 2 else ''}' href='?{i}'>{mark}{i}</a>" for i in range(n)) + "</div>"


@pytest.mark.parametrize(
    "html, labels",
    [
        ("<p><button data-toggle='dropdown'>Open</button>" + _menu(5) + "</p>", ["Open"]),
        ("<p><a data-bs-toggle='DROPDOWN' title='Told'></a><i></i>" + _menu(6, cls="options-list") + "</p>", ["Told"]),
        ("<p><button data-toggle='dropdown'></button><b>" + _menu(5, "x") + "</b></p>", ["x2"]),
        ("<div><p><span data-toggle='dropdown'>Deep</span></p><b>" + _menu(5) + "</b></div>", ["Deep"]),
        ("<div><div><p><span data-toggle='dropdown'>Too deep</span></p></div><b>" + _menu(5) + "</b></div>", []),
        ("<p><button data-toggle='dropdown'>Few</button>" + _menu(4) + "</p>", []),
        ("<nav><p><button data-toggle='dropdown'>Nav</button>" + _menu(9) + "</p></nav>", []),
        ("<p id='main-menu'><button data-toggle='dropdown'>Nav</button>" + _menu(9) + "</p>", []),
        ("<p><button data-toggle='dropdown'>Once</button>" + _menu(5) + "</p><p><button data-toggle='dropdown'>Twice</button>" + _menu(5) + "</p>", ["Once"]),
        ("<p><button data-toggle='dropdown'>A</button>" + _menu(12, "x") + "</p><p><button data-toggle='dropdown'>B</button>" + _menu(12, "y") + "</p>", ["A", "B"]),
    ],
)
def test_dropdowns(spark, html, labels):
    fields = _fields(spark, html)
    assert [f["label"] for f in fields] == labels
    assert all(f["kind"] == "select" and f["area"] == "filter" and all(o.value == o.label for o in f["options"]) for f in fields)


def test_options_in_and_out_of_forms(spark):
    html = "<select name=s><option value=1>One<option>Two</select>"
    told = lambda f: [(o.value, o.label) for o in f["options"]]
    assert told(_fields(spark, f"<form>{html}</form>")[0]) == [("1", "One"), ("Two", "Two")]
    assert told(_fields(spark, html)[0]) == [("One", "One"), ("Two", "Two")]


def test_calendar_headings_by_distance(spark):
    day = "<tr><td><a href='/d'> 7 </a></td></tr></table>"
    pages = [
        ("<h2>Mai 2020</h2><div><table><caption>Juin 2021</caption>" + day + "</div>", "2021-06-07", "caption"),
        ("<table><caption>Agenda</caption><thead><tr><th>x</th><th>2019, août</th></tr></thead>" + day, "2019-08-07", "head"),
        ("<h4>Mars 2018</h4><p>Avril 2018</p><i></i><table>" + day, "2018-04-07", "sibling"),
        ("<p>" + "long " * 9 + "Avril 2018</p><table>" + day, None, None),
        ("<h2>Mai 2020</h2><div><div><table>" + day + "</div></div>", "2020-05-07", "ancestor"),
        ("<h2>Mai 2020</h2><div><div><div><table>" + day + "</div></div></div>", None, None),
        ("<h5>May 2020</h5><b></b><b></b><b></b><b></b><table>" + day, "2020-05-07", "ancestor"),
        ("<table><caption>Mai 2020</caption><tr><td><a>32</a></td><td><a>x</a></td><td>7</td></tr></table><a>7</a>", None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, *_) in enumerate(pages)], "k int, html string")
    got = {r.k: (r.date, r.place) for r in controls.calendar_cells(generated(df, "k", "html_anchors"), "k").collect()}
    assert got == {i: (date, place) for i, (_, date, place) in enumerate(pages) if date}


def brute_language(root, node):
    """The nearest evidence, by listing all of it for every element with its distance."""
    order = list(root.walk())
    parents = {id(c): n for n in order for c in n.children}
    found = []
    for i, name in enumerate(lang.OWN_ATTRIBUTES):
        if node.attrs.get(name):
            found.append(((0, i), lang.declared_code(node.attrs[name])))
    flags = [n for n in order if n is not node and _under(parents, n, node) and n.tag in ("img", "i", "span")][:5]
    found += [((1, i), lang.flag_language(n)) for i, n in enumerate(flags)]
    kin = parents[id(node)].children if id(node) in parents else []
    at = [i for i, n in enumerate(kin) if n is node]
    for side, j in ((0, at[0] - 1), (1, at[0] + 1)) if at else ():
        if 0 <= j < len(kin):
            inner = [n for n in order if n is not kin[j] and _under(parents, n, kin[j]) and n.tag in ("img", "i", "span")][:3]
            found += [((2, side, i), lang.flag_language(n)) for i, n in enumerate([kin[j], *inner])]
    own = [f for f in found if f[0][0] == 0]
    near = own[0][1] if own else next((c for _, c in sorted(found) if c), "")
    above, distance, inherited = node, 0, []
    while above is not None:
        inherited += [(distance, i, lang.declared_code(above.attrs[a])) for i, a in enumerate(("lang", "xml:lang")) if above.attrs.get(a)]
        above, distance = parents.get(id(above)), distance + 1
    return near or (min(inherited)[2] if inherited else "")


def _under(parents, n, top):
    while id(n) in parents:
        n = parents[id(n)]
        if n is top:
            return True
    return False


def test_the_nearest_language_is_that_of_a_walk():
    rng = random.Random(5)
    marks = ["", "", "", "", " lang=fr-CA", " hreflang=en", " class=flag-icon-de", " class='fi fi-jp'", " src=/flags/it.png", " alt='Drapeau espagnol'", " xml:lang=pt_BR", " data-lang=x1", " class='lang nl'"]

    def page(depth):
        tag = rng.choice(["p", "a", "img", "i", "span", "div"])
        if tag == "img" or depth == 0:
            return f"<{tag}{rng.choice(marks)}>" + ("" if tag == "img" else f"t</{tag}>")
        return f"<{tag}{rng.choice(marks)}>" + "".join(page(depth - 1) for _ in range(rng.randint(0, 3))) + f"</{tag}>"

    told = set()
    for _ in range(150):
        root = tree("<div>" + page(4) + page(4) + "</div>")
        for node in root.walk():
            if node.parent:
                got = lang.element_language(node)
                assert got == brute_language(root, node)
                told.add(got)
    assert {"fr", "en", "de", "ja", "it", "es", "pt", "nl", ""} <= told


def test_leaves_have_columns_and_languages():
    html = """<html lang=it><table><tr><th>Name</th><th>Flag</th></tr><tr><td><span class=x1>Ann</span></td><td lang=fr>Oui</td></tr></table>
    <label for=a>Told</label><u id=a>1</u><label>Around <u>2</u></label><div data-label=Near><p><u>3</u></p></div><div class='col-3 prix'><u class=row>4</u></div>
    <p><strong>Robe :</strong> Bai</p><u>5</u><i class=flag-de></i></html>"""
    rows = list(HtmlLeaves().eval(html, 99))
    assert ("Name", "Ann", "it") in rows and ("Flag", "Oui", "fr") in rows and ("Told", "1", "it") in rows and ("Around 2", "2", "it") in rows
    assert ("Near", "3", "it") in rows and ("prix", "4", "it") in rows and ("Robe", "Bai", "it") in rows and ("u", "5", "de") in rows


def test_languages_of_leaves_are_those_of_a_walk():
    html = "<div lang=fr><p>a</p><i class=flag-de></i><p>b</p><p lang=pt>c</p></div><p>d</p><img src=/flags/jp.png>"
    root = tree(html)
    by_text = {n.text(): brute_language(root, n) for n in root.walk() if n.tag == "p"}
    assert {v: code for _, v, code in HtmlLeaves().eval(html, 99)} == by_text == {"a": "de", "b": "de", "c": "pt", "d": "de"}


@pytest.mark.parametrize(
    "text, code",
    [("fr", "fr"), ("GB", "en"), ("xx", ""), ("en-US", "en"), ("Version anglais", "en"), ("Flag of Germany with a very long description", "de"), ("a very long text that only happens to name france", ""), ("French", "fr"), ("Norwegian page", "no"), ("", "")],
)
def test_described_languages(text, code):
    assert lang.described_code(text) == code


def test_page_declarations():
    assert lang.page_declaration(tree("<html xml:lang='en-GB'><p>")) == "en"
    assert lang.page_declaration(tree("<meta http-equiv='Content-Language' content='be'>")) == "fr"
    assert lang.page_declaration(tree("<meta name='language' content='de'><meta property='og:locale' content='it_IT'>")) == "de"
    assert lang.page_declaration(tree("<p>")) == ""


def test_enriched_rows_take_script_targets_dates_and_languages(spark):
    html = """<html lang="fr"><table><caption>Mai 2020</caption><tr><td><a href="javascript:x()" onclick="$.ajax({url: './?cs=9'})">3</a></td></tr></table>
    <a href="/own">Own</a><i class="flag-de"></i><a href="" onclick="go({URL : '/later'})">Later</a>"""
    df = spark.createDataFrame([(1, html), (2, "<p>nothing</p>")], "k int, html string")
    anchors = generated(df, "k", "html_anchors")
    rows = spark.createDataFrame([(1, 0, "3", "javascript:x()"), (1, 1, "Own", "/own"), (1, 2, "Later", ""), (1, 3, "None", None), (2, 0, "3", "")], "k int, row int, text string, href string")
    got = {(r.k, r.row): (r.href, r.step_id, r.date, r.language) for r in controls.enriched_rows(rows, anchors, "k", "s1").collect()}
    assert got == {(1, 0): ("./?cs=9", "s1", "2020-05-03", "fr"), (1, 1): ("/own", "s1", "", "de"), (1, 2): ("/later", "s1", "", "fr"), (1, 3): (None, "s1", "", "fr"), (2, 0): ("", "s1", "", "")}


def test_selection_targets(spark):
    table = lambda mark, n: f"<table {mark}><thead><tr><td>h</td></tr></thead>" + "<tr><td>x</td></tr>" * n + "</table>"
    cells = "".join(f"<li class='on a x[1]'><a href='/{i}'>{i}</a></li>" for i in range(12))
    html = table("id=t1 class=big", 2) + table("class='table mt-2 prix'", 3) + table("class=table", 9) + table("id=t2", 1) + cells + "<li class=on><a>no href</a></li>"
    df = spark.createDataFrame([(1, html)], "k int, html string")
    got = {(r.kind, r.selector): (r.n, r.samples) for r in controls.selection_targets(generated(df, "k", "html_targets"), "k").collect()}
    assert got == {("table", "#t1 tr"): (2, ["x"] * 2), ("table", "table.prix tr"): (3, ["x"] * 3), ("calendar", ".on"): (12, [str(i) for i in range(10)])}


def test_html_patterns_hold_no_catastrophe():
    assert not re.search(controls.SEARCH_HINT.replace("(?i)", ""), "x" * 100_000)


def brute_submission(html, url, values):
    """The reference behaviour of a browser-less form: best form, then its body in order."""
    from urllib.parse import urlencode, urljoin

    root = tree(html)
    best, score = None, 0
    for form in (n for n in root.walk() if n.tag == "form"):
        hits = sum(bool(values.get(n.attrs.get("name", ""))) for n in form.walk() if n.tag in ("input", "select", "textarea") and n.attrs.get("type", "") not in ("submit", "file"))
        if hits > score:
            best, score = form, hits
    if best is None:
        return None
    body = {}
    for tag in ("input", "select", "textarea"):
        for n in best.walk():
            name, kind = n.attrs.get("name", ""), n.attrs.get("type", "text")
            if n.tag != tag or not name or kind in ("submit", "file"):
                continue
            if kind == "hidden":
                body[name] = n.attrs.get("value", "")
            elif name in values:
                body[name] = values[name]
            elif tag == "select":
                options = [o for o in n.walk() if o.tag == "option"]
                chosen = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
                if chosen:
                    body[name] = chosen.attrs.get("value", chosen.text())
            elif kind in ("checkbox", "radio"):
                if "checked" in n.attrs:
                    body[name] = n.attrs.get("value") or "on"
            elif tag == "input" and n.attrs.get("value"):
                body[name] = n.attrs["value"]
    action = best.attrs.get("action", "").strip()
    return score, (best.attrs.get("method") or "GET").upper(), url if action in ("", "-", "?") else urljoin(url, action), urlencode(body)


def test_the_best_form_is_sent_as_brute_force_has_it(spark):
    rng = random.Random(8)
    names = ["a", "b", "c d", "é", ""]

    def control():
        name = rng.choice(names)
        value = rng.choice(["", " value=''", " value='1'", " value='x y'"])
        kind = rng.choice(["text", "hidden", "checkbox", "radio", "submit", "file", "date"])
        options = "".join(f"<option{rng.choice(['', ' selected', ' value=o1'])}>o {i}</option>" for i in range(rng.randint(0, 3)))
        return rng.choice([f"<input name='{name}' type={kind}{value}{rng.choice(['', ' checked'])}>", f"<select name='{name}'>{options}</select>", f"<textarea name='{name}'>t</textarea>"])

    pages = []
    for k in range(120):
        forms = "".join(f"<form action='{rng.choice(['', '-', '?', '/x?y=1', 'z', 'https://o/'])}' method={rng.choice(['post', 'GET'])}>" + "".join(control() for _ in range(rng.randint(0, 5))) + "</form>" for _ in range(rng.randint(0, 3)))
        pages.append((k, forms, "https://site.example/p/q?r=1", {n: rng.choice(["", "v", "w &"]) for n in rng.sample(names[:4], rng.randint(0, 3))}))
    df = spark.createDataFrame(pages, "k int, html string, page_url string, values map<string,string>")
    rows = controls.submissions(generated(df, "k", "html_submits"), df, "k").collect()
    assert {r.k: (r.score, r.method, r.target, r.body) for r in rows} == {k: want for k, html, url, values in pages if (want := brute_submission(html, url, values))}
    assert all(r.url == (r.target.split("?")[0] + (f"?{r.body}" if r.body else "") if r.method == "GET" else r.target) for r in rows)


def test_chains_inherit_once_and_end_where_nothing_is_stored(spark):
    cell = lambda k, v: f"<td data-label='{k}'>{v}</td>"
    row = lambda *cells: "<tr>" + "".join(cells) + "</tr>"
    pages = [
        ("http://s/a", "<table>" + row(cell("N", "<a href='b'>one</a>"), cell("R", "x")) + row(cell("N", "<a href='b#again'>two</a>"), cell("R", "y")) + row(cell("N", "<a href='/gone'>three</a>")) + row(cell("N", "<a href='mailto:x'>four</a>"), cell("R", "NONE")) + "</table>"),
        ("http://s/b", "<table>" + row(cell("N", "<a href='b'>self</a>"), cell("R", "z")) + "</table>"),
        ("http://s/never", "<table>" + row(cell("N", "no"), cell("R", "no")) + "</table>"),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    picked = "td[data-label='N'], td[data-label='R']"
    steps = [chain.Step("1", picked, hand_down=("N",)), chain.Step("2", picked, ("R",), hand_down=("N", "R")), chain.Step("3", picked), chain.Step("4", picked, ("Absent",))]
    rows = chain.run_chain(df, ["http://s/a", "http://s/a", "http://s/unknown"], steps).collect()
    assert sorted((r.step_id, r.source_url, r.record.get("N"), tuple(sorted(r.inherited.items()))) for r in rows) == [
        ("1", "http://s/a", "four", ()), ("1", "http://s/a", "one", ()), ("1", "http://s/a", "three", ()), ("1", "http://s/a", "two", ()),
        ("2", "http://s/b", "self", (("N", "one"),)),
        ("3", "http://s/b", "self", (("N", "self"), ("R", "z"))),
    ]
    assert chain.run_chain(df, [], steps[:2]).count() == 0


def test_dates_are_sent_as_the_control_shows_them(spark):
    html = "<form action=a><input name=d placeholder='JJ/MM/AAAA'><input name=e value='01/02/2020'><input name=f title='yyyy-mm-dd'><input name=g pattern='dd/mm'></form>"
    df = spark.createDataFrame([(1, html, "http://h/p", dict.fromkeys("def", "2026-03-04") | {"g": "no date"})], "k int, html string, page_url string, values map<string,string>")
    submits = generated(df, "k", "html_submits")
    assert controls.submissions(submits, df, "k").first().body == "d=04%2F03%2F2026&e=04%2F03%2F2026&f=2026-03-04&g=no+date"
    assert {r.name: r.value for r in controls.current_values(submits, "k").collect()} == {"d": "", "e": "01/02/2020", "f": "", "g": ""}


def test_plain_markup_gives_the_parsers_tree():
    def parsed(html):
        parser = html_rows._Tree()
        parser.feed(html)
        parser.close()
        return parser.root

    def told(n):
        return n.tag, n.attrs, [x if isinstance(x, str) else told(x) for x in n.texts], [c.tag for c in n.children]

    rng = random.Random(5)
    bits = ["<p>", "</p>", "<br>", '<div class="a b">', "</div>", "text ", "\n é", '<input name="x" checked>', '<a href="/u?a=1"  b>', "</a>", '<textarea name="n"></textarea>', "<option>", '<td data-x="">', '<h1 a="1" a="2" >']
    odd = ["a &amp; b", "<IMG SRC=x>", "<!-- c -->", "<script>", "</script>", "x < y", "<textarea>", "<li/>", "<title>", "<p a='1'>", "</>", "<style>", "<a", '"', "<plaintext>"]
    for i in range(3000):
        html = "".join(rng.choice(bits if i % 2 else bits + odd) for _ in range(rng.randrange(12)))
        assert told(tree(html)) == told(parsed(html)), html


@pytest.mark.parametrize("pages", ["control_pages", "calendar_pages", "entry_pages", "card_pages", "form_pages"])
def test_pages_are_written_and_parsed_in_tasks_for_all_cores(spark, pages):
    rows = getattr(markup, pages)(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_pages_of_cards_and_links_are_parsed_once(spark):
    for name in ("card_groups", "enriched_links"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") <= 1
