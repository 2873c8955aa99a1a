"""Table records whose rows keep their cells together: one shuffle, the same records."""

from turfline.operators import extraction
from turfline.plans import registry

from .test_extraction import TABLE, generated
from .test_queries import SF_DIR, pytestmark  # noqa: F401

REPEATED = """<table><tr><th>Nom</th><th>Nom</th><th>Rang</th><th></th></tr><tr><td></td><td><a href="/b">Bea</a></td><td>2 e</td><td data-label=" Club ">Pau</td><td>x</td></tr>
<tr><td><a href="/c"></a></td><td></td><td>abc</td><td><a href="/d" title="Dax"></a></td></tr><tr><td>Ann</td><td>Bea</td><td></td></tr></table>"""


def test_team_records_shuffle_rows_once_after_parsing(spark):
    plan = registry.QUERIES["team_records"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("MapInArrow")].count("Exchange hashpartitioning") == 1


def test_repeated_columns_take_the_first_value_and_its_link(spark):
    rows = extraction.row_records(extraction.cells_of(generated(spark, "html_table_rows", REPEATED)), "page_id").orderBy("row").collect()
    assert [dict(r.record) for r in rows] == [
        {"Nom": "Bea", "Rang": "2", "Club": "Pau", "col_4": "x", "Nom_url": "/b", "href": "/b"},
        {"Rang": "-1", "col_3": "Dax", "Nom_url": "/c", "col_3_url": "/d", "href": "/c"},
        {"Nom": "Ann"},
    ]


def test_records_of_rows_and_of_cells_agree(spark):
    for html in (TABLE, REPEATED):
        by_cell = extraction.table_records(generated(spark, "html_cells", html), "page_id").collect()
        by_row = extraction.row_records(extraction.cells_of(generated(spark, "html_table_rows", html)), "page_id").collect()
        assert sorted(map(str, by_cell)) == sorted(map(str, by_row)) and by_row
