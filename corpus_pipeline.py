"""Corpus preparation in five stages: quality rules, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. The
caller writes a stage's result and gives it to the next.

Defined cases: null and empty texts have no words, so quality_rules drops them; where the other stages meet them they stay
as they are, and source_mix takes nothing of them. Null ids and sources are kept; rows with a null id are documents of
their own, one of a group of near copies stays even if all its ids are null. Of repeated rows near_duplicates keeps one.
An empty table gives an empty one in every stage. Columns that `documents` don't have are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, neardup, packing, quality, repeats
from quillon.llm.common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A repeated passage has over 50 words.
PASSAGE_WORDS = 51
#: SQL for run()'s rows: estimation, signatures and tokens have none; the stages are tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules and their estimated accuracies reject."""
    return quality.kept_rows(spark, docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near duplicates (similarity 0.8 or more on shingles of five words)."""
    return neardup.representatives(spark, docs, percent=80).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 51 words or more, or of 400 bytes or more, that also occur elsewhere. A document that is nothing but such passages stays, without text."""
    kept = repeats.remove_repeats(spark, docs, more=("lang", "source"), with_text=True, words=PASSAGE_WORDS)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share: a row for each pass that takes a document, with the words that it takes."""
    return mixing.mixed_rows(spark, docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens of documents that are neighbours on the curve, as pieces."""
    return packing.pack(spark, docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
