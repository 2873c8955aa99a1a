"""Many rows go to more tasks than the session's shuffle partitions, with the same results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from turfline.operators import profiles, relational
from turfline.plans import registry

from .test_queries import SF_DIR, TABLES, comparable, pytestmark  # noqa: F401


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return db


def largest_task(rows):
    return rows.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def same_as_twin(spark, oracle, name):
    got, want = registry.QUERIES[name](spark, SF_DIR), oracle.execute(registry.ORACLES[name])
    return comparable(got.columns, [tuple(r) for r in got.collect()]) == comparable([d[0] for d in want.description], want.fetchall())


# 200 parts are dealt at 100 rows a task and broadcast at 200.
@pytest.mark.parametrize("rows_a_task", [100, 200])
def test_a_task_of_outcome_label_holds_few_rows_however_many_there_are(spark, oracle, monkeypatch, rows_a_task):
    monkeypatch.setattr(relational, "ROWS_A_TASK", rows_a_task)
    assert largest_task(registry.QUERIES["outcome_label"](spark, SF_DIR)) <= 3 * rows_a_task
    assert same_as_twin(spark, oracle, "outcome_label")


def test_few_rows_stay_as_they_are(spark):
    rows = spark.range(4000)
    assert relational.dealt(rows, 4 * relational.ROWS_A_TASK, "id") is rows
    assert relational.dealt(rows, 4 * relational.ROWS_A_TASK + 1, "id").rdd.getNumPartitions() == 5


def test_a_task_of_clean_rows_holds_few_rows_with_many_shuffle_partitions_too(spark, oracle, monkeypatch):
    # Spark joins partitions of few bytes, so that their number alone bounds nothing.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert largest_task(registry.QUERIES["clean_rows"](spark, SF_DIR)) > 1000
        monkeypatch.setattr(relational, "ROWS_A_TASK", 150)
        assert largest_task(registry.QUERIES["clean_rows"](spark, SF_DIR)) <= 450
        assert same_as_twin(spark, oracle, "clean_rows")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# 12 parts are dealt at 5 rows a task and broadcast at 20; 600 rows are dealt at both.
@pytest.mark.parametrize("rows_a_task", [5, 20, relational.ROWS_A_TASK])
def test_clean_rows_of_odd_rows_are_the_same_however_they_are_dealt(spark, tmp_path, monkeypatch, rows_a_task):
    db = duckdb.connect()
    odd = {
        # Each row three times; orders and parts that are null, missing, repeated or without a size or type; ranks below 0 and null ones.
        "lineitem": f"""SELECT nullif(i % 23, 22)::BIGINT AS l_orderkey, nullif(i % 17, 16)::BIGINT AS l_partkey, (i % 3)::INTEGER AS l_linenumber,
                        CASE WHEN i % 11 < 10 THEN i % 11 - 1 END::DOUBLE AS l_quantity, l.* EXCLUDE (l_orderkey, l_partkey, l_linenumber, l_quantity, i)
                        FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM '{SF_DIR}/lineitem.parquet' LIMIT 200) l, range(3) AS copies""",
        "orders": f"SELECT nullif(i % 19, 18)::BIGINT AS o_orderkey, o.* EXCLUDE (o_orderkey, i) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM '{SF_DIR}/orders.parquet' LIMIT 40) o",
        "part": f"""SELECT nullif(i % 10, 9)::BIGINT AS p_partkey, CASE WHEN i % 10 < 7 THEN p_size END AS p_size, CASE WHEN i % 10 > 2 THEN p_type END AS p_type, p.* EXCLUDE (p_partkey, p_size, p_type, i)
                    FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM '{SF_DIR}/part.parquet' LIMIT 12) p""",
    }
    for name, sql in odd.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    monkeypatch.setattr(relational, "ROWS_A_TASK", rows_a_task)
    got, want = registry.QUERIES["clean_rows"](spark, str(tmp_path)), db.execute(registry.ORACLES["clean_rows"])
    rows = [tuple(r) for r in got.collect()]
    assert 0 < len(rows) < 600 and any(None in r for r in rows)
    assert comparable(got.columns, rows) == comparable([d[0] for d in want.description], want.fetchall())
    # Rows are dealt before they are made unique.
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert ("REPARTITION_BY_NUM" in plan[plan.index("Aggregate") :]) == (rows_a_task < 500)


@pytest.mark.parametrize("rows_a_task", [2, relational.ROWS_A_TASK])
def test_families_of_pairs_hold_missing_and_repeated_ones_and_unfold_last(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(relational, "ROWS_A_TASK", rows_a_task)
    facts = [(1, 7, "a"), (1, 7, "a"), (1, None, "b"), (None, 7, None), (None, 7, "c"), (2, 8, None), (2, 7, None), (3, 9, "a"), (3, 9, "d"), (None, 9, "d"), (4, None, "e"), (None, None, "f")]
    got = profiles.pair_families(spark.createDataFrame(facts, "horse long, rider long, family string"))
    pairs = {(h, r) for h, r, _ in facts if h is not None and r is not None}
    want = {(h, r, f) for h, r in pairs for x, y, f in facts if x == h or y == r}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    # The plan's top: pairs are unfolded, nothing is shuffled or made unique afterwards.
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate explode") < min(plan.index(x) for x in ("Aggregate", "Join"))


def test_discipline_explosion_gives_the_same_rows_when_dealt(spark, oracle, monkeypatch):
    monkeypatch.setattr(relational, "ROWS_A_TASK", 150)
    assert same_as_twin(spark, oracle, "discipline_explosion")
