"""Documents through quality rules, line dedup, near-duplicates, decontamination and mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns rows with the columns of documents;
the last returns what the mix takes of each document.

For every stage: a null or empty text is a text without words; an empty table gives an empty result; very long texts
are read whole; rows of equal doc_id are judged each by its own text, equal rows alike; doc_id may be null (it counts
as the largest) and must be a whole number for line_dedup; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrier.llm import decontaminate, lines, mixing, quality, similar
from harrier.llm.queries import table
from harrier.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rules, as texts without words do, and those the forest rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go; n_chars follows the text, a null text stays null."""
    return lines.clean(docs, lines.build(docs), length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates stays: SimHash links, and similarity 0.8 or more.

    Texts without words are one group; rows that repeat the smallest id of a group all stay.
    """
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; texts without words hold none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken. Texts without words have size 0 and are never taken."""
    return mixing.mix(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix_sources)]

#: A forest's verdicts can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
