"""The corpus pipeline: quality rules, quality classifier, line dedup, near-duplicate removal, packing.

Each stage reads what its predecessor kept, written as Parquet, with the columns of ``documents``; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.llm import line_crf, line_dedup, near_dedup, packing, quality_classifier
from reelscope.llm.common import materialize, table


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the content share keep."""
    given = table(spark, sf_dir, "documents")
    return line_crf.keep_content(docs, line_crf.train(given, table(spark, sf_dir, "labels")))


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    given = table(spark, sf_dir, "documents")
    return quality_classifier.keep_good(docs, quality_classifier.train(given, table(spark, sf_dir, "labels")))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; ``n_chars`` follows the text."""
    left = line_dedup.remove_spread_lines(docs, counts=False)
    counts = F.char_length("text").cast("long")
    return left.select(*[counts.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("line_dedup", remove_lines),
    ("near_dedup", keep_one_of_each_class),
    ("packing", pack),
]

#: Trained models and signatures can't be expressed in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
