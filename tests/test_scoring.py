"""Predictions: the steps that gather what history says, on odd rows, and the disk that they leave."""

import random
import time
from collections import Counter
from statistics import median

import duckdb
import pytest
from pyspark.sql import functions as F

from turfline.operators import relational, scoring
from turfline.plans import registry
from turfline.staging import stage

from .test_queries import SF_DIR, comparable, pytestmark  # noqa: F401

QUERIES = ("feature_vector", "pair_prediction", "family_predictions", "combo_means", "batch_cold_start")


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [found.apply(i).getName() for i in range(found.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def left_after(spark, before, most):
    """Shuffle files beyond those of before: they go soon after a write, not at once."""
    for _ in range(50):
        if len(left := shuffle_files(spark) - before) <= most:
            break
        time.sleep(0.1)
    return len(left)


def test_a_staged_table_that_frees_its_shuffles_leaves_none(spark):
    before, parts = shuffle_files(spark), spark.conf.get("spark.sql.shuffle.partitions")
    rows = stage(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "freed", free=True, partitions=9)
    assert rows.count() == 7 and spark.conf.get("spark.sql.shuffle.partitions") == parts
    assert left_after(spark, before, 1) <= 1  # that of count()


def test_features_leave_no_shuffle_of_the_participations(spark):
    before = shuffle_files(spark)
    registry.QUERIES["feature_vector"](spark, SF_DIR)
    assert left_after(spark, before, 8) <= 8  # of small tables that tell what to do, such as hot keys


def test_families_of_predictions_are_unfolded_where_their_riders_are(spark):
    plan = registry.QUERIES["family_predictions"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan[: plan.index("Generate explode(array_union")]


def usual(values):
    counts = Counter(v for v in values if v is not None)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def told(rows):
    """What a portrait of these rows holds."""
    modes = {c: usual([r[c] for r in rows]) for c in (*scoring.CATEGORIES, "level")}
    heights = [r["height"] for r in rows if r["height"] is not None]
    return modes | {"n": len(rows), "height": median(heights) if heights else None, "team": mean([r["team"] for r in rows]), "field": mean([r["field"] for r in rows]), "level_num": mean([r["level"] for r in rows])}


def same(portrait, want):
    return all(portrait[k] == v or abs(portrait[k] - v) < 1e-12 for k, v in want.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_portraits_of_horses_and_families_with_missing_values_and_ties(spark, seed):
    rng = random.Random(seed)
    any_of = lambda *x: rng.choice([*x, None])
    rows = [{"horse": any_of(1, 2, 3, 40), "family": any_of("a", "b"), "height": any_of(90, 100, 115), "level": any_of(9, 10, 11), "won": 1, "pts": any_of(1, 2), "field": any_of(3, 8), "team": rng.randrange(2)} | {c: any_of("x", "y") for c in scoring.CATEGORIES} for _ in range(60)]
    rows.append(rows[0] | {"horse": 5, "family": "a"})  # of one family, whose rows are not read again
    history = spark.createDataFrame([tuple(r.values()) for r in rows], "horse long, family string, height int, level int, won int, pts int, field long, team int, " + ", ".join(f"{c} string" for c in scoring.CATEGORIES))
    horses = {r.horse: r for r in scoring._horses(history, len(rows), "won").collect()}
    assert set(horses) == {r["horse"] for r in rows} - {None}
    for h, got in horses.items():
        mine = [r for r in rows if r["horse"] == h]
        assert got._usual == usual([r["family"] for r in mine]) and same(got._h, told(mine)) and got._h.sum_won == len(mine)
        assert set(got._by) == {r["family"] for r in mine} - {None}
        assert all(same(p, told([r for r in mine if r["family"] == f])) for f, p in got._by.items())
    families, every = scoring._families(history)
    assert all(same(r._f, told([x for x in rows if x["family"] == r._family])) for r in families.collect()) and families.count() == 2
    one = every.first()
    assert one._every == usual([r["family"] for r in rows]) and same(one._a, told(rows))


@pytest.mark.parametrize("rows_a_task", [50, relational.ROWS_A_TASK])
def test_predictions_of_odd_rows_match_their_twins(spark, tmp_path, monkeypatch, rows_a_task):
    db = duckdb.connect()
    odd = {
        # Each row twice; orders and parts that are null, missing or without a size, type or date; orders that are repeated.
        "lineitem": f"""SELECT nullif(i % 43, 42)::BIGINT AS l_orderkey, nullif(i % 13, 12)::BIGINT AS l_partkey, nullif(i % 5, 4)::BIGINT AS l_suppkey, l.* EXCLUDE (l_orderkey, l_partkey, l_suppkey, i)
                        FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM '{SF_DIR}/lineitem.parquet' LIMIT 200) l, range(2) AS copies""",
        "orders": f"""SELECT nullif(i % 39, 38)::BIGINT AS o_orderkey, nullif(i % 9, 8)::BIGINT AS o_custkey, CASE WHEN i % 11 = 0 THEN NULL WHEN i % 3 = 0 THEN TIMESTAMP '2001-06-01' ELSE o_orderdate END AS o_orderdate,
                        o.* EXCLUDE (o_orderkey, o_custkey, o_orderdate, i) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM '{SF_DIR}/orders.parquet' LIMIT 45) o""",
        "part": f"""SELECT i AS p_partkey, CASE WHEN i % 10 < 7 THEN p_size END AS p_size, CASE WHEN i % 10 > 2 THEN p_type END AS p_type, p.* EXCLUDE (p_partkey, p_size, p_type, i)
                    FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM '{SF_DIR}/part.parquet' LIMIT 11) p""",
    }
    for name, sql in odd.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    monkeypatch.setattr(relational, "ROWS_A_TASK", rows_a_task)
    for query in QUERIES:
        got, want = registry.QUERIES[query](spark, str(tmp_path)), db.execute(registry.ORACLES[query])
        rows = [tuple(r) for r in got.collect()]
        assert rows and comparable(got.columns, rows) == comparable([d[0] for d in want.description], want.fetchall()), query
