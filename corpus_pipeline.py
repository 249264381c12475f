"""The corpus pipeline: five stages over ``documents``, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``.  ``run`` writes each stage's result as Parquet to the shared folder and reads it again,
so a lost executor costs tasks of one stage; what the stage had written for itself, and the result
before, is deleted then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import bpe, decontaminate, quality, similar, suffixes
from factorloom.llm.common import discard, materialise, read_table, scratch, stage_folder


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null texts are judged as empty ones, equal texts alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays.

    A document is a row of an id and a text: of rows that repeat both, one stays; rows of one id
    with different texts are different documents; rows without an id give way to those with one.
    """
    return similar.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more stay at their first occurrence (by id, text, place) only; no document goes."""
    return suffixes.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with benchmark items go; null and empty texts never are, equal texts go together."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of each row that is left (null text: as empty)."""
    return bpe.token_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("bpe", encoding)]
#: The quality model, the grouping and the encoding are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        kept = scratch(spark, f"kept-{name}")
        with stage_folder(spark, f"stage-{name}"):
            docs = materialise(stage(spark, docs, sf_dir), name, path=kept)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
