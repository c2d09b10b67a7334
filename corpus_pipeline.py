"""From raw documents to packed training sequences, by five operators; each stage is written and read again.

All stages but the last return the columns of ``documents``, with n_chars that of the text as it is then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, near_dup, packing, quality, substring_dup
from tracewell.llm.shared import Scratch, released


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rejected documents go, frequent lines of their host leave the others.

    Lines are counted by texts here, so that the copies of a text reach the next stage, which keeps one of them.
    """
    return _counted(quality.clean(docs, per="texts"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the document with the smallest doc_id of each group of near-duplicates stays."""
    return near_dup.one_of_each(docs).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: repeated passages go; a document left without a word goes with them, one without repeats stays as it is."""
    out = substring_dup.remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _counted(out.withColumn("text", text)).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents sampled so that tokens meet the target shares."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row per token piece with its place in a training sequence."""
    pieces = Scratch(spark, "packing").table(packing.digests(packing.token_pieces(docs)))
    return packing.pack(pieces)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("substring dedup", substring_dedup), ("mixing", mixture), ("packing", packed)]
#: Tokenising and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage reads, and its operators' own tables, go once its result is written."""
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
