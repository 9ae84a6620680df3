"""From raw documents to packed training sequences: quality rules, line de-duplication, near duplicates, benchmark
passages, packing. Every stage but the last returns the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm.decontaminate import decontaminate
from sparkveil.llm.line_windows import dedup_lines
from sparkveil.llm.packing import pack
from sparkveil.llm.queries import table, tokenizer
from sparkveil.llm.repetition import keep_good
from sparkveil.llm.setsketch import keep_one_of_each
from sparkveil.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a repetition rule go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines in a row go, and documents of which no word is left."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity of 0.8 or more."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2,048."""
    return pack(docs, tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Packing follows a tokenizer file, which SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
