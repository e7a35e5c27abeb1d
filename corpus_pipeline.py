"""The corpus pipeline: from documents to packed sequences.

Each stage reads the table that the one before it wrote. All but the last return the columns of
documents; the last returns a row for each packed piece.

Defined results: null and empty texts are not toxic, have too few words for the quality rules and so
go there; the later stages, given them, keep them, and pack an end id each. Documents without an
id pass the join as they are. Of repeated rows the join keeps one, of a group the least doc_id, and of rows
that tie in it the least hash of their texts. Very long texts are read whole by each stage and packed in full pieces. Empty tables pass all stages and give no
rows. Other columns, whatever their names, stay as they are but for n_chars, which follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import Scratch, table
from spillway.llm.jaccard_join import keep_one
from spillway.llm.lines import line_dedup
from spillway.llm.packing import best_fit_packing
from spillway.llm.quality import quality_filter
from spillway.llm.toxicity import toxicity_filter
from spillway.scratch import temporary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those predicted toxic; the machine learns from the labels of this stage's documents."""
    return toxicity_filter(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the rules of documents and hosts."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their hosts repeat; n_chars follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces, packed into sequences of 2048 ids."""
    return best_fit_packing(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("jaccard_join", jaccard_join),
    ("best_fit_packing", packing),
]

#: SQL can't express the kernel machine nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary():  # what a stage has written on its way goes once its result is saved, as does the table that it has read
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
