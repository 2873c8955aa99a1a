"""Joins to a table with one row per key, without a task that holds a hot key.

What is broadcast is counted first: at most BROADCAST_ROWS rows of a key and a few numbers, some 64 bytes each in
memory and so 64 MB; tables with wider rows should be joined by their keys first.

Defined results: a null key matches nothing in join_spread, and is a key like any other in beside_key; repeated
rows stay repeated; empty tables give no rows (inner) or rows with nulls (left); columns of the table that
are named like those of the rows must be renamed by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import stage

#: Rows that may be broadcast: a few short columns each.
BROADCAST_ROWS = 1_000_000
#: From this many rows a key is hot: in a join, and in a window, whose tasks hold a key's rows anyhow.
HOT_ROWS, HOT_WINDOW = 1_000, 20_000


def small_or_joined(keys: DataFrame) -> DataFrame:
    """Broadcast `keys` if they are few; otherwise leave the join to a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to `table`, which has one row per key and in `weight` how many of rows hold it.

    Keys held by HOT_ROWS rows or more are broadcast, and their rows stay where they are;
    all others meet by a shuffle. There are at most BROADCAST_ROWS hot keys: the limit
    rises with the number of rows. A null key matches nothing.
    """
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    limit = max(HOT_ROWS, -(-(total or 0) // BROADCAST_ROWS))
    if (most or 0) < limit:
        return rows.join(table, key, how)
    hot = table.where(F.col(weight) >= limit)
    names = F.broadcast(hot.select(key))
    cold = rows.join(names, key, "left_anti").join(table.join(names, key, "left_anti"), key, how)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def beside_key(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """rows with aggregates of all rows of their key: by a window, and for hot keys by a broadcast of their few aggregates."""
    hot = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HOT_WINDOW), "hot-keys")
    number, total = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    over = {name: value.over(Window.partitionBy(key)) for name, value in values.items()}
    if not number:
        return rows.withColumns(over)
    if number > BROADCAST_ROWS:
        hot = hot.where(F.col("_n") >= -(-total // BROADCAST_ROWS))
    names = F.broadcast(hot.select(key))
    warm = rows.join(names, key, "left_semi")
    table = warm.groupBy(key).agg(*[value.alias(name) for name, value in values.items()])
    return rows.join(names, key, "left_anti").withColumns(over).unionByName(warm.join(F.broadcast(table), key))
