"""A corpus pipeline of five stages, each an operator of ``assayframe.llm``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet and read again before the next.  All but the last
return the columns of ``documents``.

Stages decide on rows, which they tell apart by their places in the files that
they read, so rows without an id, with one that others have, or equal to others
in every column have fates of their own.  The order of the mix survives: its
rows are sorted over files and inside them, and the last stage tells each row's
place in that order.

Defined results, for every stage: an empty table gives an empty one; null texts
count as empty (and are never taken by the mix, which takes no empty text);
columns beyond those of ``documents`` are left out.  Documents without labels in
``labels`` are judged like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm import curriculum, exact_index, merge_table, minhash, pairwise_quality
from assayframe.llm.common import documents, new_path, passing, remove, with_row_key
from assayframe.llm.queries import MIX_SCHEDULES, MIX_WEIGHTS, piece_model, quality_ranking

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts at or above its cut."""
    return pairwise_quality.keep_good(docs.select(*COLUMNS), quality_ranking(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, and one of those that share it."""
    return exact_index.keep_first_of_equal(docs.select(*COLUMNS), exact_index.fresh_index(spark, docs.count()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity of 0.8 or more) one row: of those with the smallest doc_id the first."""
    keyed, row = with_row_key(docs.select(*COLUMNS))
    dropped = minhash.near_duplicates(keyed, 80, 100, row_col=row).where("NOT first").select(F.col("key").alias(row))
    return keyed.join(dropped.hint("merge"), row, "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken documents, each as often as the mix takes it, in training order."""
    return curriculum.training_order(docs.select(*COLUMNS), MIX_WEIGHTS, schedules=MIX_SCHEDULES)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, the text that they give back, and ``place``, by which rows sort in the order of ``docs``."""
    keyed, row = with_row_key(docs.select(*COLUMNS), "place")
    coded = merge_table.encode_texts(keyed, piece_model(), also=[row])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded", F.col(row).alias("place"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: No SQL expresses the classifier, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage leaves in the shared folder goes when the next has read it."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
