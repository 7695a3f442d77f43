"""A corpus pipeline: language ID, quality rules, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage
before it kept. All but the last return the columns of documents. Every stage
takes an empty table, which gives an empty result, and further columns, whatever
their names; those stay. The stages' docstrings tell of nulls, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from warpline.llm import langid, linededup, packing, quality, simhash
from warpline.plans.scratch import Scratch

#: No stage that learns, hashes or tokenises has an SQL form.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go.

    So do null and empty texts and those without a letter. Without a labelled row
    nothing can be told, and all go. Equal rows are judged alike.
    """
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go.

    A null text has no words and goes. Without labels the base rule alone
    decides; of several labels of a document the lowest counts. Equal rows are
    judged alike; a row without doc_id is judged and has no label.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one occurrence stays; documents without a line left go.

    The first by (doc_id, line number) stays. Null and empty texts stay as they
    are, and so do rows without doc_id. Equal rows lose the same lines; rows of
    one doc_id and different texts lose their own.
    """
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of smallest doc_id.

    Texts without a word, null ones included, are near to each other. Of equal
    rows one stays; rows without doc_id stay.
    """
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens.

    A null text is empty and has the end alone. Equal rows are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
