"""A chain of extraction steps over stored pages: each step reads the pages that its parent's rows link to.

A step's pages are the frontier's URLs met with the stored pages; links to pages that are not stored
lead nowhere. Rows are picked by selectors, rows without a required value go, and what is left gives the
next frontier: absolute http links, each once, with the columns that they hand down. Every step's rows are
staged, so a lost executor costs one step at most.

Defined results: a URL that several rows link to is read once and inherits from the first of them, by
source URL and position; a page that links to itself or back is read again in the next step only;
a chain ends early where a frontier is empty; pages of the same URL are all read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html_rows, html_select
from ..functions import text as t
from ..staging import stage
from .extraction import selected_records


@dataclass(frozen=True)
class Step:
    """selector: what gives a row's cells; required: columns that a row must have a value in; follow: columns that may hold its link, the
    first that does counts; hand_down: columns that the rows of the pages behind it inherit."""

    step_id: str
    selector: str
    required: tuple[str, ...] = ()
    follow: tuple[str, ...] = ("href", "content")
    hand_down: tuple[str, ...] = field(default=())


_NOTHING = "cast(map() AS map<string, string>)"


def _rows_of(pages: DataFrame, frontier: DataFrame, step: Step) -> DataFrame:
    """step_id, source_url, position, record, inherited: the rows of the frontier's pages that have all required values."""
    spark = pages.sparkSession
    html_select.register(spark)
    met = pages.select(F.col("url").alias("source_url"), "html").join(frontier.withColumnRenamed("url", "source_url"), "source_url")
    met = met.withColumn("page", F.monotonically_increasing_id())
    met = stage(met, "chain-pages")
    met.createOrReplaceTempView("chain_pages")
    quoted = step.selector.replace("\\", "\\\\").replace("'", "\\'")
    cells = spark.sql(f"SELECT m.page, c.* FROM chain_pages m, LATERAL html_select(html, '{quoted}') c")
    rows = selected_records(cells, "page").join(met.select("page", "source_url", "inherited"), "page")
    for column in step.required:
        rows = rows.where(F.coalesce(t.has_value(F.col("record")[column]), F.lit(False)))
    return stage(rows.select(F.lit(step.step_id).alias("step_id"), "source_url", "position", "record", "inherited"), "chain-rows")


def _link(step: Step) -> Column:
    return F.coalesce(*[F.nullif(t.strip(F.col("record")[c]), F.lit("")) for c in step.follow])


def _frontier(rows: DataFrame, step: Step) -> DataFrame:
    """url, inherited: the absolute http links of a step's rows, each once."""
    own = F.map_filter("record", lambda k, v: k.isin(*step.hand_down)) if step.hand_down else F.expr(_NOTHING)
    older = F.map_filter("inherited", lambda k, v: ~F.array_contains(F.map_keys(own), k))
    links = rows.withColumns({"_link": _link(step), "_down": F.map_concat(older, own)}).where("_link IS NOT NULL")
    # A fragment names a place in a page, not another page.
    links = links.withColumn("url", F.regexp_replace(html_rows.absolute_url()("source_url", "_link"), "#.*$", ""))
    links = links.where(F.col("url").rlike("^https?://"))
    # A map can't be compared, so the first is found by its place and the map goes along as entries.
    first = links.groupBy("url").agg(F.min_by(F.map_entries("_down"), F.struct("source_url", "position")).alias("down"))
    return first.select("url", F.map_from_entries("down").alias("inherited"))


def run_chain(pages: DataFrame, entries: list[str], steps: list[Step]) -> DataFrame:
    """step_id, source_url, position, record, inherited of all steps. pages: url, html."""
    spark = pages.sparkSession
    frontier = spark.createDataFrame([(x,) for x in dict.fromkeys(entries)], "url string").withColumn("inherited", F.expr(_NOTHING))
    out = None
    for step in steps:
        rows = _rows_of(pages, frontier, step)
        out = rows if out is None else out.unionByName(rows)
        frontier = _frontier(rows, step)
    return out
