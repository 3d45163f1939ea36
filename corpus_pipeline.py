"""A corpus in five stages: quality, repeated lines, near copies, the mix of sources, packing.

A stage takes what its predecessor kept and returns the columns of documents; the last one returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bagminhash import keep_one
from tidemark.llm.common import cut_lineage, table
from tidemark.llm.lines import line_dedup
from tidemark.llm.mixing import mix_rows
from tidemark.llm.packing import packed
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import WORD_BPE, fold


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 go. Labels of the fold held out are not learned."""
    return keep_good(docs, table(spark, sf_dir, "labels"), learn=F.coalesce(fold("doc_id", 4) != 2, F.lit(True)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and documents all of whose lines were copies. n_chars follows the text."""
    out = line_dedup(docs)
    changed = F.col("n_kept") < F.col("n_lines")
    kept = out.where(F.coalesce(~changed | F.col("text").rlike(r"[^ \n]"), F.lit(True)))
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; those it does not take go."""
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return packed(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("packing", packing)]

#: Tokenizer, signatures and the learned scores are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
