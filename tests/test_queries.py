"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from turfline.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are absent")


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return db


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_twin(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF_DIR)
    want = oracle.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert comparable(got.columns, [tuple(r) for r in got.collect()]) == comparable(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()


def test_a_model_of_earlier_contests_beats_chance_on_later_ones(spark):
    rows = registry.QUERIES["fit_and_score"](spark, SF_DIR)
    late = rows.where("is_test").agg(F.count(F.lit(1)).alias("n"), F.corr("proba", "won").alias("r"), F.min("proba").alias("lo"), F.max("proba").alias("hi")).first()
    assert 0.1 * rows.count() < late.n < 0.3 * rows.count() and 0 <= late.lo < late.hi <= 1 and late.r > -0.05


def test_staged_rows_hold_no_column_that_only_orders_them(spark):
    plan = lambda name: registry.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().analyzed().toString()
    assert "price" not in plan("stratified_split") and "Window" not in plan("fit_and_score")
