"""An event log fed by a stream: every event once, in one sequence, read by cursors.

A micro-batch becomes one part of the log, and the commit that names the part also marks the batch's number and
the last sequence number given. A batch that is run again after a crash finds its number marked and changes
nothing; one that crashed before its commit left no trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.places import with_place
from ..sources.store import State, Store

#: Kinds of events that a job publishes.
KINDS = ("step_started", "progress", "row", "url_row", "finalized", "finished", "done", "error")
#: What an event tells; `data` is JSON.
EVENT_SCHEMA = "session string, kind string, step string, ts timestamp, data string"


class EventLog:
    def __init__(self, store: Store, table: str = "events"):
        self.store, self.table = store, table

    def append_batch(self, batch: DataFrame, number: int, stream: str = "stream") -> State:
        """The batch's events of a known kind, numbered on in the order of time and content; nothing if the number is marked."""
        mark, last = f"{stream}-batch", f"{self.table}-last"

        def step(base: State):
            if int(base.marks.get(mark, -1)) >= number:
                return None
            given = int(base.marks.get(last, 0))
            order = [F.col(c).asc_nulls_first() for c in ("ts", "session", "step", "kind", "data")]
            rows = with_place(batch.where(F.col("kind").isin(*KINDS)), order, "seq").withColumn("seq", F.col("seq") + given)
            part = self.store.add_part(self.table, rows)
            many = self.store.spark.read.parquet(f"{self.store.root}/{part}").count()
            return {self.table: [*base.tables.get(self.table, []), part]}, {mark: str(number), last: str(given + many)}

        return self.store.change(step)

    def follow(self, events: DataFrame, checkpoint: str, stream: str = "stream", **trigger: object) -> StreamingQuery:
        """Start appending a stream; events must have EVENT_SCHEMA. `checkpoint` must stay the same over restarts."""
        writer = events.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        return writer.foreachBatch(lambda batch, number: self.append_batch(batch, number, stream)).start()

    def poll(self, cursor: int, session: str | None = None) -> tuple[DataFrame | None, int]:
        """The events after a cursor, in a state that later batches don't change, and the next cursor."""
        now = self.store.state()
        rows, last = self.store.read(self.table, now), int(now.marks.get(f"{self.table}-last", 0))
        if rows is None or cursor >= last:
            return None, max(cursor, last)
        rows = rows.where(F.col("seq") > cursor)
        return (rows if session is None else rows.where(F.col("session") == session)), last


def progress_of(events: DataFrame) -> DataFrame:
    """session, step, rows, urls, finished, failed: counters of every step from its events."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return events.where("step IS NOT NULL").groupBy("session", "step").agg(count("row").alias("rows"), count("url_row").alias("urls"), (count("finished", "finalized") > 0).alias("finished"), (count("error") > 0).alias("failed"))


def jobs_of(events: DataFrame) -> DataFrame:
    """session, started, seen, steps, rows, urls, state of every job, from its events; running until it is done or tells an error outside of a step."""
    kind = F.col("kind")
    failed, done = F.bool_or((kind == "error") & F.col("step").isNull()), F.bool_or(kind == "done")
    counts = [F.count_distinct(F.when(kind == "step_started", F.col("step"))).alias("steps"), F.count_if(kind == "row").alias("rows"), F.count_if(kind == "url_row").alias("urls")]
    return events.groupBy("session").agg(F.min("ts").alias("started"), F.max("ts").alias("seen"), *counts, F.when(failed, "error").when(done, "done").otherwise("running").alias("state"))
