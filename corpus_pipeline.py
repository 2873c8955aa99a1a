"""A corpus from raw documents in five stages, each a Spark job over all its predecessor kept.

quality rules -> toxicity -> near duplicates -> mixing -> packing. Every function takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. run() writes each result as Parquet into the shared folder and reads it
back, so a lost executor costs one stage at most.

Defined results: a document without text or words fails the base rules and goes in the first stage; a null lang
or source is a group of its own; a null doc_id keeps its document, which has no label; rows that repeat a doc_id with
its text are near copies of each other, of which one stays; an empty table runs through all stages and gives no
rows; columns beyond those of COLUMNS are dropped at the start.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turfline.llm.jaccard_join import keep_one_of_each
from turfline.llm.mixing import materialize_mix
from turfline.llm.packing import pack_documents
from turfline.llm.quality_rules import keep_clean
from turfline.llm.toxicity import keep_civil
from turfline.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive fences."""
    return keep_clean(docs.select(*COLUMNS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the classifier is fitted on the labelled ones among them."""
    return keep_civil(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id."""
    return keep_one_of_each(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for every whole repetition, and one for a part, cut after its last word taken."""
    return materialize_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack_documents(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Classifiers and set similarity are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
